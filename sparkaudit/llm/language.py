"""Language identification: the family first, then one-versus-one linear support vector machines within it."""
from itertools import combinations

from pyspark.sql import functions as F

from ..session import materialise
from .text_model import ends, fit_classes, fit_margin, hash_share, letter_words, with_features

# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
# Training documents of each language, at most (a sample by hash).
PER_LANGUAGE = 2000
# Places that tokens are hashed to, and steps of each fit.
FEATURES, ITERATIONS = 1 << 14, 15
UNKNOWN = "und"


def family_of(language):
    return next((f for f, members in FAMILIES.items() if language in members), language)


def language_tokens(text):
    """Short words, word beginnings and endings."""
    words = letter_words(text)
    return F.concat(F.filter(words, lambda w: F.length(w) <= 4), ends(words))


class LanguageModel:
    """Fitted on the rows of ``train`` (text, language); reads nothing but the text."""

    def __init__(self, train, text="text", lang="lang", per_language=PER_LANGUAGE):
        train = train.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
        sizes = materialise(train.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")))
        self.languages = sorted(r["_lang"] for r in sizes.select("_lang").collect())
        families = {}
        for x in self.languages:
            families.setdefault(family_of(x), []).append(x)
        self.families = [families[f] for f in sorted(families)]
        # copies of a text are one row of the sample, so it stays bounded; the order makes the fits the same on every run
        chosen = (train.join(F.broadcast(sizes), "_lang").where(hash_share(F.col("_text")) < F.lit(float(per_language)) / F.col("_n"))
                  .select("_text", "_lang").distinct().sortWithinPartitions("_text", "_lang"))
        number = F.create_map(*[F.lit(v) for i, f in enumerate(self.families) for x in f for v in (x, float(i))]) if self.languages else None
        self.family, self.pairs = None, {}
        if len(self.languages) < 2:
            return
        sample = materialise(with_features(chosen, language_tokens(F.col("_text")), FEATURES).select("_x", "_lang", number[F.col("_lang")].alias("_family")))
        if len(self.families) > 1:
            self.family = fit_classes(sample, "_family", ITERATIONS)
        for members in self.families:
            for a, b in combinations(members, 2):
                two = sample.where(F.col("_lang").isin(a, b)).withColumn("_first", (F.col("_lang") == a).cast("double"))
                self.pairs[a, b] = fit_margin(two, "_first", ITERATIONS)

    def predict(self, docs, text="text"):
        """``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of these names are replaced.

        ``und`` with score 0 where the text is missing or has no letter, or where nothing was learned. Within the likeliest
        family the language that wins most duels is taken (ties: the better margins, then the name).
        """
        names = [c for c in docs.columns if c not in ("lang_pred", "score")]
        # the input columns travel as one, by position, so any name may occur
        row = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
        docs = docs.select(row.alias("_row"), F.col(text).alias("_text"))
        columns = [F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names)]
        none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        if not self.languages:
            return docs.select(*columns, none["lang"].alias("lang_pred"), none["score"].alias("score"))
        scored = with_features(docs, language_tokens(F.col("_text")), FEATURES)
        if self.family:
            scored = self.family(scored, "_family")
        for i, ((_, _), model) in enumerate(self.pairs.items()):
            scored = model(scored, f"_m{i}")
        for i in range(len(self.pairs)):
            scored = scored.withColumn(f"_m{i}", 1 / (1 + F.exp(-4 * F.col(f"_m{i}"))))
        chance = {}
        for i, (a, b) in enumerate(self.pairs):
            chance.setdefault(a, []).append(F.col(f"_m{i}"))
            chance.setdefault(b, []).append(1 - F.col(f"_m{i}"))

        def rated(x, p):
            duels = F.array(*chance.get(x, [F.lit(1.0)]))
            wins = F.size(F.filter(duels, lambda d: d > 0.5))
            mean = F.aggregate(duels, F.lit(0.0), lambda s, d: s + d) / F.size(duels)
            return F.struct((-wins).alias("lost"), (-mean).alias("worse"), F.lit(x).alias("lang"), (mean * p).alias("score"))

        p = [F.col("_family")[i] if self.family else F.lit(1.0) for i in range(len(self.families))]
        groups = [F.array_min(F.array(*[rated(x, p[i]) for x in members])) for i, members in enumerate(self.families)]
        groups = [F.struct((-p[i]).alias("p"), F.struct(g["lang"].alias("lang"), g["score"].alias("score")).alias("best")) for i, g in enumerate(groups)]
        best = F.array_min(F.array(*groups))["best"]
        scored = scored.withColumn("_best", F.when(F.col("_text").rlike(r"\p{L}"), best).otherwise(none))
        return scored.select(*columns, F.col("_best.lang").alias("lang_pred"), F.col("_best.score").alias("score"))


def held_out(id_col="doc_id"):
    """Rows that are kept from training: a quarter by the checksum of the id's text. A missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def identify_languages(docs, id_col="doc_id", text="text", lang="lang"):
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``: learned from the rows that are not held out, applied to all.

    One row for each input row. Labels that are missing teach nothing; an empty table gives an empty table.
    """
    docs = docs.drop("held_out")
    model = LanguageModel(docs.where(~held_out(id_col)), text, lang)
    return model.predict(docs.withColumn("held_out", held_out(id_col)), text)
