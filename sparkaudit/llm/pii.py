"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are always reported when they pass their check. The method adds iban (mod-97),
ssn and secret spans where checksum, form and nearby words give a score of at least ``MIN_SCORE``. Offsets count code
points and ends are exclusive. Every scan is linear in the text, whatever it holds.
"""
import re

import pandas as pd
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")
MIN_SCORE = 0.5
# Code points before and after a span whose words count as its context.
NEAR = 40

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|[0-9a-f]{32,64})(?![A-Za-z0-9])")
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "api", "apikey", "api_key"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
WORD = re.compile(r"[a-z_-]+")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits):
    """Check digit of payment cards: every second digit from the right is doubled, its digits added."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def mod97(text):
    """Check of international account numbers: 15 to 34 characters, remainder 1."""
    code = text.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text):
    """Leftmost matches of the mail pattern. Searched from each ``@`` outwards: a long run of letters costs no retries."""
    done = 0
    for at in re.finditer("@", text):
        p = at.start()
        if p < done:
            continue
        start = p
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, p) if start < p else None
        if found:
            done = found.end()
            yield start, done


def addresses(text):
    """Four numbers of at most 255 between dots, taken four by four from each run of dotted numbers."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text):
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text):
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def ibans(text):
    for m in IBAN.finditer(text):
        end = m.end()
        # the pattern may have taken following capital words along: drop them until the remainder fits
        while end > m.start() and not mod97(text[m.start():end]):
            end = text.rfind(" ", m.start(), end)
        if end > m.start():
            yield m.start(), end


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans,
           "ssn": lambda t: (m.span() for m in SSN.finditer(t)),
           "secret": lambda t: (m.span() for m in SECRET.finditer(t))}


def score(text, kind, start, end):
    """Prior of the kind, raised where a word of its context stands nearby."""
    around = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    near = any(w in CONTEXT[kind] for w in WORD.findall(around.lower()))
    key = kind == "secret" and text.startswith(("AKIA", "gh"), start)
    return min(1.0, PRIOR[kind] + (0.3 if near else 0.0) + (0.5 if key else 0.0))


def spans_of(text):
    """All spans of one text as (kind, start, end, score), kind by kind and then by start."""
    found = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text or ""):
            points = score(text, kind, start, end)
            if kind in BASE or points >= MIN_SCORE:
                found.append((kind, start, end, points))
    return found


def _spans(texts: pd.Series) -> pd.Series:
    keys = ("kind", "start", "end", "score")
    return pd.Series([[dict(zip(keys, s, strict=True)) for s in spans_of(t)] for t in texts])


def find_pii(docs, text="text"):
    """``docs`` with the column ``pii``: the spans of the whole text; a missing or empty text has none.

    One pass without a shuffle. All rows and columns stay; a column named ``pii`` is replaced.
    """
    spans = F.pandas_udf(_spans, SPANS)
    return docs.withColumn("pii", spans(F.coalesce(F.col(text), F.lit(""))))


def span_list(spans):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_pii(docs, text="text"):
    """``docs`` with every span of its ``text`` replaced by its kind in brackets; overlapping spans share one mask."""
    merged = F.aggregate(
        F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["s"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["e"]).alias("at")))
        .otherwise(F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["s"] - acc["at"]),
                                     F.lit("["), s["k"], F.lit("]")).alias("out"), s["e"].alias("at"))))
    found = find_pii(docs, text).withColumn("_merged", merged)
    rest = F.substring(F.col(text), F.col("_merged")["at"] + 1, F.length(text))
    return found.withColumn(text, F.concat(F.col("_merged")["out"], rest)).drop("_merged")
