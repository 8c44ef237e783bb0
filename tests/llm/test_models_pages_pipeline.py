"""Language, quality, page text and the pipeline: held-out accuracy, edge cases, brute force."""
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkaudit.llm import language, main_text, quality
from sparkaudit.llm.language import LanguageModel, identify_languages
from sparkaudit.llm.main_text import DEPTH, extract_text, page_blocks, suffix_array
from sparkaudit.llm.quality import classify_quality, shrunk

FOLDER = Path("/root/testdata/sf0.01")
MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

# Word stems of four invented languages, two of a family each.
STEMS = {"de": ["auf", "ich", "ung", "sch"], "nl": ["een", "ijk", "het", "oor"], "es": ["ción", "ñas", "que", "los"], "pt": ["ção", "nho", "que", "dos"]}


def sentence(rnd, lang):
    return " ".join("".join(rnd.choices(STEMS[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(6, 30)))


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, lang), lang) for i, lang in enumerate(rnd.choices(list(STEMS), k=400))]
    return rows + [(1000, None, "de"), (1001, "", "es"), (1002, "123 ### !!", "de"), (1003, sentence(rnd, "nl"), None), (7, rows[7][1], rows[7][2]), (None, "auf ich", "de")]


def test_languages_of_held_out_documents(spark, prose):
    df = spark.createDataFrame([(k, t, x, 1.0) for k, t, x in prose], "doc_id long, text string, lang string, score double")
    rows = identify_languages(df).collect()
    assert len(rows) == len(prose)
    for r in rows:
        out = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2
        assert r["held_out"] == out and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    tested = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(tested) > 60 and np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.97
    assert next(r for r in rows if r["doc_id"] == 1003)["lang_pred"] == "nl"


def test_predictions_read_the_text_alone(spark, prose):
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string")
    known = df.where("doc_id < 1000")
    new = df.where("doc_id < 40").select((F.col("doc_id") * 100 + 100_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    first = {r["text"]: r["lang_pred"] for r in identify_languages(known).where("doc_id < 40").collect()}
    second = {r["text"]: r["lang_pred"] for r in identify_languages(known.union(new)).where("doc_id >= 100000").collect()}
    assert first == second


def test_languages_beside_columns_named_like_the_inner_ones(spark, prose):
    names = ["_tokens", "_raw", "_x", "_family", "_m0", "_best", "_row", "_text", "_r", "_p", "_c", "none", "c0"]
    plain = spark.createDataFrame([r for r in prose if r[0] is not None], "doc_id long, text string, lang string")
    named = plain.select("*", *[F.lit(n).alias(n) for n in names])
    want = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in identify_languages(plain).collect()}
    got = identify_languages(named).collect()
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in got} == want
    assert all(r[n] == n for r in got for n in names)


def test_copies_of_a_text_do_not_enlarge_the_sample(spark, prose, monkeypatch):
    many = spark.createDataFrame(prose + [prose[0]] * 500, "doc_id long, text string, lang string")
    held = []
    stored = language.materialise
    monkeypatch.setattr(language, "materialise", lambda df: held.append(stored(df)) or held[-1])
    LanguageModel(many, per_language=2_000)
    assert held[-1].count() <= len({r[1:] for r in prose})


def test_language_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(df).collect()} == {("und", 0.0)}
    assert identify_languages(df.where("false")).collect() == []
    one = spark.createDataFrame([(i, "auf ich", "de") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in identify_languages(one).collect()} == {("de", 1.0)}


@pytest.mark.skipif(not FOLDER.exists(), reason="tables not present")
def test_quality_of_documents_without_a_label(spark):
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    labels = spark.read.parquet(str(FOLDER / "labels.parquet"))
    seen = F.crc32(F.col("doc_id").cast("string")) % 3 != 0
    rows = classify_quality(docs, labels.where(seen), "source", "lang").join(labels.where(~seen), "doc_id").collect()
    good = [r["quality"] == 1 and r["toxic"] == 0 for r in rows]
    assert len(rows) > 100 and np.mean([r["keep"] == g for r, g in zip(rows, good, strict=True)]) > 0.8
    assert np.mean([r["keep"] for r, g in zip(rows, good, strict=True) if g]) > 0.95


def test_sparse_sites_are_drawn_to_the_level_above(spark):
    groups = spark.createDataFrame([("big", 1000.0, 900.0), ("tiny", 1.0, 0.0), ("mid", 50.0, 10.0)], "g string, _n double, _sum double")
    rows = {r["g"]: r for r in shrunk(groups.withColumn("_mean", F.col("_sum") / F.col("_n")).withColumn("_up", F.lit(0.5))).collect()}
    assert abs(rows["big"]["_post"] - 0.9) < 0.01 and 0.2 < rows["tiny"]["_post"] < 0.5 and abs(rows["mid"]["_post"] - 0.2) < abs(rows["tiny"]["_post"] - 0.0)
    alike = groups.withColumn("_mean", F.lit(0.5)).withColumn("_sum", F.col("_n") / 2).withColumn("_up", F.lit(0.5))
    assert {r["_m"] for r in shrunk(alike).collect()} == {1e6}


def test_a_bad_site_lowers_and_a_good_one_raises(spark):
    rows = [(i, "good words here" if i % 10 else "BAD!! $$$ THING!!", "a", "x") for i in range(60)]
    rows += [(100 + i, "BAD!! $$$ THING!!" if i % 10 else "good words here", "b", "x") for i in range(60)]
    rows += [(300, None, None, None), (301, " ", "a", None), (5, rows[5][1], "a", "x")]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, host string, path string, score double")
    labels = spark.createDataFrame([(k, int("good" in t), 0) for k, t, *_ in rows[:120:2]] + [(0, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify_quality(docs, labels, "host", "path").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["p_site"] > by[110]["p_site"] and by[1]["keep"] and not by[101]["keep"] and by[1]["score"] > by[110]["score"]
    assert not by[300]["keep"] and not by[301]["keep"]
    assert classify_quality(docs.where("false"), labels, "host", "path").collect() == []
    assert {r["p_doc"] for r in classify_quality(docs.where("doc_id < 50"), labels.where("false"), "host", "path").collect()} == {0.25}


def test_blocks_of_broken_and_nested_markup():
    page = ('<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><h1>T &amp; x</h1><p>a<br>b '
            '<span class="ad">buy</span> c&nbsp;d<p>e<ul><li>x<li>y</ul><aside>no</aside><form>q</form><section class="comments"><p>no</p></section>'
            '<script>if(a<b){"</p>"}</script><!-- <p>no</p> -->5 < 6 &lt;b&gt;</main><footer>&copy;</footer>')
    blocks, main = page_blocks(page)
    assert main and [t for r, t in blocks if r == main_text.CONTENT] == ["T & x", "a b c d", "e", "x", "y", "5 < 6 <b>"]
    for odd in ("", "<", "<p", "<p <p <p", "</p></p>", "<!--", "<script>x", "plain", '<a "' * 1000):
        page_blocks(odd)


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a "' * 200_001, "<!--" * 200_000, "<div>" * 50_000 + "</p>" * 50_000, "<script>" * 100_000, "&amp" * 200_000])
def test_long_pages_cost_linear_time(page):
    page_blocks(page)


def test_suffix_array_orders_all_long_substrings():
    rng = np.random.default_rng(0)
    tokens, page = rng.integers(0, 3, 90).astype(np.uint64), np.repeat([0, 1, 2], 30)
    start, rank = suffix_array(tokens, page)
    assert sorted(start) == [i for i in range(90 - DEPTH + 1) if page[i] == page[i + DEPTH - 1]]
    keys = [tuple(tokens[i:i + DEPTH]) for i in start]
    assert keys == sorted(keys) and all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], rank, rank[1:], strict=False))


@pytest.mark.parametrize("shard", [256, 3])
def test_repeated_blocks_of_a_host_go_and_articles_stay(spark, shard, monkeypatch):
    monkeypatch.setattr(main_text, "SHARD", shard)
    top, end = "<div>Home about us contact the whole team</div>", "<div>Copyright by the owners of this site and others</div>"
    body = "Page {0} tells of {1} things, {2} people, {3} cars and {4} trees in a way of its own"
    rows, want = [], {}
    for i in range(12):
        own = body.format(*[i * 31 + k * 7 for k in range(5)])
        rows.append((i, f"http://h{i % 2}.org/x{i}", f"{top}<p>{own}</p>{end}"))
        want[i] = own
    rows += [(50, "http://h0.org/a", "<article><p>Home about us contact the whole team</p></article>" + end), (51, None, None), (52, "x", ""),
             (53, "http://lone.org/", f"{top}<p>{want[0]}</p>"), (0, rows[0][1], rows[0][2])]
    want |= {50: "Home about us contact the whole team", 51: "", 52: "", 53: "Home about us contact the whole team\n\n" + want[0]}
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, n_chars int")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in found)
    assert extract_text(df.where("false")).collect() == []


@pytest.mark.skipif(not (FOLDER.exists() and MODEL.exists()), reason="tables or tokenizer files not present")
def test_every_stage_of_the_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from test_copies_and_leaks import brute, overlapping
    rnd = random.Random(3)
    folder = tmp_path / "tables"
    text = lambda: "\n".join(sentence(rnd, "es") for _ in range(6))
    rows = [(i, text(), "es") for i in range(40)] + [(100 + i, text().replace("ñas", "nas"), "es") for i in range(5)]
    rows += [(200 + i, rows[i][1], "es") for i in range(5)] + [(300, "### 12", "es"), (301, None, "es")]
    rows = [(k, t if k >= 300 else t + "\nTodos los derechos reservados", x) for k, t, x in rows]
    passage = " ".join(f"marca{i}" for i in range(20))
    rows += [(400, text() + "\n" + passage, "es"), (401, text() + "\n" + passage.replace("marca3 ", "otra "), "es")]
    df = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs, kept = df, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, str(folder))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        ids = sorted(r["doc_id"] for r in kept[name])
        if name == "language":
            assert ids == sorted(k for k, *_ in rows if k not in (300, 301))
        elif name == "line_dedup":
            assert len(ids) == len(before) and not any("derechos" in r["text"] for r in kept[name]) and all(r["n_chars"] == len(r["text"]) for r in kept[name])
        elif name == "near_duplicates":
            assert ids == sorted(set(brute([(r["doc_id"], r["text"]) for r in before])[1]))
        elif name == "decontamination":
            assert ids == sorted(r["doc_id"] for r in before if not overlapping(r["text"], passage)) and not {400, 401} & set(ids)
        if name != "encoding":
            assert docs.columns == df.columns
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in kept["encoding"])
    whole = pipeline.run(spark, str(folder)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in whole) == sorted((r["doc_id"], r["ids"]) for r in kept["encoding"])


def test_the_rest_works_without_the_subpackage():
    import subprocess
    root = Path(__file__).resolve().parents[2]
    code = ("import sys, builtins; real = builtins.__import__\n"
            "class Gone:\n    def find_spec(self, name, *a):\n        if name.startswith('sparkaudit.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone()); import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op1_') for q in e.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=100)
    assert out.stdout.split()[1:] == ["False"], out.stderr


@pytest.mark.parametrize("wrapper", ['class="content-sidebar-wrap"', 'class="has-sidebar"', 'class="no-sidebar wide"', 'class="search-results"',
                                     'class="comment-enabled"', 'class="sidebar"', 'id="site-header"', 'class="widget"', 'class="sidebar"><div class="no-ads"'])
@pytest.mark.parametrize("part", ["main", "article"])
def test_a_name_of_a_wrapper_drops_no_main_part(wrapper, part):
    blocks, main = page_blocks(f'<div {wrapper}><nav>no</nav><div class="menu">no</div><{part}><p>the text</p><div class="ad">no</div></{part}></div>')
    assert main and [t for r, t in blocks if r == main_text.CONTENT] == ["the text"]


def test_comments_adverts_and_elements_of_the_page_frame_hold_no_main_part():
    for page in ('<div class="comments"><article>no</article></div>', '<div class="sidebar"><article class="comment-body">no</article></div>',
                 '<div class="widget"><div class="ad-300x250"><article>no</article></div></div>', '<nav><main>no</main></nav>',
                 '<aside class="sidebar"><article>no</article></aside>', '<div class="site-footer">no</div>', '<div class="main-nav menu">no</div>'):
        blocks, main = page_blocks(page)
        assert not main and [r for r, _ in blocks] == [main_text.DROPPED], page
    blocks, main = page_blocks('<div class="has-sidebar">yes</div><div class="search-results">yes</div>')
    assert not main and [r for r, _ in blocks] == [main_text.OPEN] * 2


@pytest.mark.parametrize("many,shard", [(12, 4), (2500, 256)])
def test_quotes_headings_and_stock_phrases_are_no_boilerplate(spark, many, shard, monkeypatch):
    monkeypatch.setattr(main_text, "SHARD", shard)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    stock = ["on the other hand it is", "as a matter of fact we", "at the end of the day"]
    quote = " ".join(rnd.choices(words, k=60))
    menu = "<ul><li>Home<li>News of the day<li>Contact</ul>"
    end = f"<div>{' '.join(rnd.choices(words, k=45))}</div><div>Copyright by the owners of this site</div>"
    rows, want = [], {}
    for i in range(many):
        blocks = [" ".join(rnd.choice(stock) + " " + " ".join(rnd.choices(words, k=6)) for _ in range(8)) for _ in range(2)]
        blocks += [quote] if i < 3 else []
        blocks.insert(1, "What the people say about it" if i % 5 == 0 else f"Part {i}")
        rows.append((i, "http://h.org/", f"{menu}{''.join(f'<p>{b}</p>' for b in blocks)}{end}"))
        want[i] = "\n\n".join(blocks)
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == many and [r["page_id"] for r in got if r["text"] != want[r["page_id"]]] == []


@pytest.mark.parametrize("shard", [256, 3])
def test_blocks_of_main_parts_are_in_the_suffix_arrays(spark, shard, monkeypatch):
    monkeypatch.setattr(main_text, "SHARD", shard)
    notice = " ".join(f"term{i}" for i in range(50))
    tokens, owner = main_text.stream(page_blocks(f"<div>top of it</div><article><p>{notice}</p></article>")[0])
    assert len(tokens) == 53 and owner.tolist() == [0] * 3 + [1] * 50
    rows = [(i, "http://h.org/", f"<article><p>{notice}</p><p>Own text {i}</p></article>") for i in range(12)]
    rows += [(50, "http://h.org/", f"<div>{notice}</div><p>A page that has no article</p>")]
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"{notice}\n\nOwn text {i}" for i in range(12)}, 50: "A page that has no article"}


@pytest.mark.skipif(not FOLDER.exists(), reason="tables not present")
def test_pages_keep_their_text_without_the_article_tags(spark):
    pages = spark.read.parquet(str(FOLDER / "pages.parquet"))
    plain = pages.withColumn("html", F.regexp_replace("html", "(?i)<(/?)(article|main)\\b", "<$1div"))
    got = {r["page_id"]: r["text"] for r in extract_text(plain).collect()}
    want = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    lost = [b for i, t in want.items() for b in t.split("\n\n") if b not in got[i].split("\n\n")]
    assert want and not lost


def test_pages_with_columns_named_like_the_inner_ones(spark):
    names = ["_host", "_page", "_kept", "_text", "_html", "_others", "text"]
    rows = [(i, "http://h.org/", f"<article>page {i}</article><p>end", *names) for i in range(6)] + [(6, None, None, *names)]
    df = spark.createDataFrame(rows, f"page_id long, url string, html string, {', '.join(n + ' string' for n in names)}")
    got = extract_text(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == {**{i: f"page {i}" for i in range(6)}, 6: ""}
    assert all([r[n] for n in names[:-1]] == names[:-1] for r in got)


def test_site_beliefs_equal_the_posterior_computed_by_hand(spark):
    rnd = random.Random(11)
    words = {1: ["clear", "useful", "careful", "sound"], 0: ["buy", "click", "spam", "junk"]}
    docs, labels = [], []
    for i in range(240):
        host = "big" if i % 3 == 0 else f"h{i % 11}"
        good = int(rnd.random() < {"big": 0.8}.get(host, (i % 11) / 11))
        docs.append((i, " ".join(rnd.choices(words[good], k=12)) if i % 29 else None, host if i % 31 else None, f"/{i % 4}" if i % 7 else None))
        labels.append((i, good, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, host string, path string")
    rows = {r["doc_id"]: r for r in classify_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "host", "path").collect()}
    p = {i: rows[i]["p_doc"] for i in rows}
    site = {d[0]: (d[2] or "", d[3] or "") for d in docs}

    def level(members, up):
        """{group: (n, sum, mean above)} -> weight of the level above, by the method of moments."""
        n = np.array([len(v) for v in members.values()], float)
        mean = np.array([np.mean([p[i] for i in v]) for v in members.values()])
        above = np.array([up(g) for g in members])
        spread, d = above * (1 - above), n.sum() - (n ** 2).sum() / n.sum()
        between = max(((n * (mean - above) ** 2).sum() - spread.sum()) / d, 0) if d > 0 else 0
        m = spread.mean() / between - 1 if between > 0 else quality.MOST
        return min(max(m, quality.LEAST), quality.MOST)

    def groups(key):
        out = {}
        for i in p:
            out.setdefault(key(i), []).append(i)
        return out

    whole = np.mean(list(p.values()))
    hosts, paths = groups(lambda i: site[i][0]), groups(lambda i: site[i])
    m_host = level(hosts, lambda g: whole)
    belief = {h: (sum(p[i] for i in v) + m_host * whole) / (len(v) + m_host) for h, v in hosts.items()}
    m_path = level(paths, lambda g: belief[g[0]])

    def logit(x):
        x = min(max(x, 1e-6), 1 - 1e-6)
        return np.log(x / (1 - x))

    for i, r in rows.items():
        v = paths[site[i]]
        own = (sum(p[j] for j in v) - p[i] + m_path * belief[site[i][0]]) / (len(v) - 1 + m_path)
        score = 1 / (1 + np.exp(-(logit(p[i]) + logit(min(max(own, 0), 1)) - logit(whole))))
        assert r["p_site"] == pytest.approx(own, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)
        assert r["keep"] == (r["score"] >= 0.5)
    assert len(rows) == 240


@pytest.mark.parametrize("shard", [256, 3])
def test_main_parts_of_every_host_are_in_the_suffix_arrays(spark, shard, monkeypatch):
    """Also on a host where no page is left open, and in every array; a copy of a page counts once."""
    monkeypatch.setattr(main_text, "SHARD", shard)
    notice = " ".join(f"term{i}" for i in range(40))
    rows = [(i, f"http://h{i % 2}.org/", f"<article><p>{notice}</p><p>Own text of page {i}</p></article>") for i in range(24)]
    rows += [(99, "http://h2.org/", f"<article>{notice}</article>")] * 9
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    source = df.select(F.regexp_extract("url", main_text.URL_HOST, 1).alias("_host"), F.xxhash64("html").alias("_page"), F.col("html").alias("_html"))
    streams = main_text.host_streams(source)
    assert {(r["_host"], r["_of"], len(main_text.stream_of(r["_words"])[0])) for r in streams.collect()} == {("h0.org", 12, 45), ("h1.org", 12, 45), ("h2.org", 1, 40)}
    found = main_text.boilerplate(streams).collect()
    # 13 substrings of the notice and the words after it on each of two hosts, on all of their pages
    assert len(found) == 26 == len({r["_hash"] for r in found}) and {r["_pages"] for r in found} == {12}
