"""The same queries as SQL for another engine, written from the definitions: pairs, ranks and windows, no shortcuts."""
from ..operators.score import t_critical
from ..plans.audit import FLAGS, REPORT_COLUMNS
from ..plans.validation import FLOORED, ROBUST
from ..schema import (COMPARED, LEGACY_HOME_KEY, LEGACY_PLACEHOLDERS, LEGACY_PROPERTY_KEY, LISTING_COLUMNS, LISTING_KEY,
                      LISTING_TYPES, MODEL_FEATURES, PROPERTY_KEY, SENTINEL_DATES, STATUSES)
from .queries import BASELINES, FOLDS, SEED, SEEDS, SHARES, SPEC
from .tables import LABELS, LISTINGS, QUOTED, RAW, RECENT


def names(columns, prefix=""):
    return ", ".join(f"{prefix}{c}" for c in columns)


def texts(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def day(column="prev_sold_date"):
    return (f"CASE WHEN regexp_full_match({column}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND TRY_CAST({column} AS DATE) "
            f"BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN TRY_CAST({column} AS DATE) END")


def hash60(*parts):
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15) AS BIGINT)"


def present(columns, prefix=""):
    return " AND ".join(f"{prefix}{c} IS NOT NULL" for c in columns)


def rnd(value, digits=6):
    return f"ROUND({value}, {digits})"


def base(source="listings"):
    """CTEs: listings (and recent), each with the parsed day."""
    more = f", recent AS ({RECENT})" if source == "recent" else ""
    return f"WITH listings AS ({LISTINGS}){more}, t AS (SELECT *, {day()} AS day FROM {source})"


INVALID = (f"(prev_sold_date IS NOT NULL AND (day IS NULL OR prev_sold_date IN ({texts(SENTINEL_DATES)}) "
           "OR day < DATE '1900-01-02' OR day > DATE '2026-12-31'))")
PLACEHOLDER = (f"(lower(coalesce(prev_sold_date, 'nan')) IN ({texts(LEGACY_PLACEHOLDERS)}) "
               "OR contains(lower(coalesce(prev_sold_date, 'nan')), '####'))")

COMPATIBLE = " AND ".join(f"(a.{c} = b.{c} OR a.{c} IS NULL OR b.{c} IS NULL)" for c in COMPARED) + (
    " AND (abs(a.price - b.price) <= 0.01 * greatest(a.price, b.price) OR a.price IS NULL OR b.price IS NULL)")
DUPLICATES = f"""dups AS (SELECT DISTINCT a.rid FROM t a JOIN t b
  ON {" AND ".join(f"a.{c} = b.{c}" for c in LISTING_KEY)} AND a.rid <> b.rid WHERE {COMPATIBLE})"""

STATS = """long AS (
  SELECT 'group' AS level, CAST(g AS VARCHAR) AS key, m.measure, m.v FROM vals, LATERAL (
    SELECT unnest(measures) AS measure, unnest(vs) AS v) m WHERE m.v IS NOT NULL
  UNION ALL
  SELECT 'fallback', CAST(f AS VARCHAR), m.measure, m.v FROM vals, LATERAL (
    SELECT unnest(measures) AS measure, unnest(vs) AS v) m WHERE m.v IS NOT NULL),
med AS (SELECT level, key, measure, count(*) AS n, median(v) AS med FROM long GROUP BY ALL),
stats AS (SELECT med.level, med.key, med.measure, any_value(med.n) AS n, any_value(med.med) AS med,
            median(abs(long.v - med.med)) AS mad
          FROM long JOIN med USING (level, key, measure) GROUP BY ALL),
floors AS (SELECT measure, quantile_cont(mad, 0.05) AS mad_floor FROM stats WHERE level = 'group' AND n >= 20
           GROUP BY measure)"""

PRICE_VALS = """vals AS (SELECT rid, coalesce(zip_code, -1.0) AS g, coalesce(state, '?') AS f,
  ['per_size', 'price'] AS measures,
  [CASE WHEN price > 0 AND house_size > 0 THEN ln(price) - ln(house_size) END,
   CASE WHEN price > 0 THEN ln(price) END] AS vs FROM t)"""


def chosen(measure, floor=True):
    """CTE body: rid, v, med, mad, fallback of one measure."""
    use = "(g.n IS NULL OR g.n < 20 OR g.mad IS NULL OR g.mad = 0)"
    mad = f"CASE WHEN {use} THEN s.mad ELSE g.mad END"
    floored = f"CASE WHEN {mad} IS NOT NULL THEN greatest({mad}, (SELECT mad_floor FROM floors WHERE measure = '{measure}')) END"
    index = {"per_size": 1, "price": 2}.get(measure, 1)
    return f"""SELECT vals.*, vals.vs[{index}] AS v, CASE WHEN {use} THEN s.med ELSE g.med END AS med,
      {floored if floor else mad} AS mad, {use} AS fallback
    FROM vals LEFT JOIN stats g ON g.level = 'group' AND g.key = CAST(vals.g AS VARCHAR) AND g.measure = '{measure}'
    LEFT JOIN stats s ON s.level = 'fallback' AND s.key = CAST(vals.f AS VARCHAR) AND s.measure = '{measure}'"""


Z = ("CASE WHEN mad <> 0 THEN 0.6745 * (v - med) / mad WHEN v > med THEN 'inf'::DOUBLE "
     "WHEN v < med THEN '-inf'::DOUBLE END")


def price_z(name="scored", floor=True, with_stats=True):
    return (f"{PRICE_VALS}, {STATS}, " if with_stats else "") + f"""{name}_1 AS (SELECT rid, {Z} AS z FROM ({chosen("per_size", floor)})),
{name}_2 AS (SELECT rid, {Z} AS z FROM ({chosen("price", floor)})),
{name} AS (SELECT t.*, CASE WHEN t.price <= 0 THEN 'inf'::DOUBLE ELSE coalesce(abs(a.z), abs(b.z), 0.0) END AS price_z
  FROM t JOIN {name}_1 a USING (rid) JOIN {name}_2 b USING (rid))"""


FINITE6 = "CASE WHEN isinf(price_z) THEN price_z ELSE round(price_z, 6) END"

FLAGGED = f"""flagged AS (SELECT scored.*, {INVALID} AS invalid_date, (dups.rid IS NOT NULL) AS listing_duplicate,
  coalesce(price = 0, false) AS zero_price, (price_z > 3.5 AND NOT coalesce(price = 0, false)) AS price_outlier
  FROM scored LEFT JOIN dups USING (rid))"""
ANY_FLAG = " OR ".join(FLAGS)
AUDIT = f"{base()}, {DUPLICATES}, {price_z()}, {FLAGGED}"

RANGES = [("price", "greater_than(0)", "NOT price > 0"), ("price", "less_than_or_equal_to(1000000000.0)", "NOT price <= 1e9"),
          ("bed", "in_range(0, 50)", "NOT bed BETWEEN 0 AND 50"), ("bath", "in_range(0, 50)", "NOT bath BETWEEN 0 AND 50"),
          ("acre_lot", "greater_than_or_equal_to(0)", "NOT acre_lot >= 0"),
          ("house_size", "greater_than(0)", "NOT house_size > 0"),
          ("house_size", "less_than_or_equal_to(100000)", "NOT house_size <= 100000"),
          ("zip_code", "in_range(0, 99999)", "NOT zip_code BETWEEN 0 AND 99999")]
PATTERN = [("prev_sold_date", r"str_matches('^\d{4}-\d{2}-\d{2}$')",
            r"NOT regexp_full_match(prev_sold_date, '\d{4}-\d{2}-\d{2}')")]
ROWS = [("(row)", "sold record has a sale date", "status = 'sold' AND prev_sold_date IS NULL"),
        ("(row)", "ready_to_build record has no previous sale", "status = 'ready_to_build' AND prev_sold_date IS NOT NULL")]


def violations(checks, table="t"):
    parts = " UNION ALL ".join(
        f"SELECT {texts([c])} AS \"column\", {texts([k])} AS \"check\", count(*) AS violations FROM {table} WHERE {bad}"
        for c, k, bad in checks)
    return f"SELECT * FROM ({parts}) WHERE violations > 0"


def raw_checks():
    return f"WITH listings AS ({LISTINGS}), t AS ({RAW}) "


COERCION = [(c, "coerce_dtype('float64')", f"{c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL")
            for c in LISTING_COLUMNS if LISTING_TYPES[c] == "double"]
CATEGORIES = [("status", "not_nullable", "status IS NULL"),
              ("status", "isin([" + ", ".join(f"'{s}'" for s in STATUSES) + "])", f"status NOT IN ({texts(STATUSES)})")]

SUMMARY = f"""summary AS (
  SELECT 'records' AS part, 'records' AS item, '' AS detail, CAST(count(*) AS DOUBLE) AS value FROM t
  UNION ALL SELECT 'records', 'records_flagged', '', count(*) FROM flagged WHERE {ANY_FLAG}
  {" ".join(f"UNION ALL SELECT 'flags', '{f}', '', count(*) FROM flagged WHERE {f}" for f in FLAGS)}
  UNION ALL SELECT 'expectations', "column", "check", violations FROM ({violations(RANGES + PATTERN + ROWS)})
  UNION ALL SELECT 'context', 'records_sharing_an_address', '', coalesce(sum(n), 0) FROM (
    SELECT count(*) AS n FROM t WHERE {present(PROPERTY_KEY)} GROUP BY {names(PROPERTY_KEY)} HAVING count(*) > 1)
  UNION ALL SELECT 'missing_prev_sold_date_by_status', status, '',
    round_even(avg(CASE WHEN prev_sold_date IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM t GROUP BY status)"""


def report_lines():
    def number(item):
        return f"(SELECT format('{{:,}}', CAST(value AS BIGINT)) FROM summary WHERE item = '{item}')"

    head = [texts(["# Data quality audit: `orders.parquet`"]), "''",
            f"{number('records')} || ' records · ' || {number('records_flagged')} || ' flagged (' || "
            "(SELECT printf('%.2f', 100 * max(value) FILTER (item = 'records_flagged') / max(value) FILTER (item = 'records')) FROM summary)"
            " || '%) · generated 2026-01-01T00:00:00+00:00'",
            "''", "'## Flags'", "''", "'| Flag | Records | Meaning |'", "'|---|---:|---|'",
            *[f"'| `{f}` | ' || {number(f)} || {texts([f' | {meaning} |'])}" for f, meaning in FLAGS.items()],
            "''", "'## Contract expectations'", "''"]
    table = """list_concat(['| Column | Check | Violations |', '|---|---|---:|'],
      (SELECT list('| ' || item || ' | `' || detail || '` | ' || format('{:,}', CAST(value AS BIGINT)) || ' |'
                   ORDER BY value DESC, item, detail) FROM summary WHERE part = 'expectations'))"""
    tail = ["''", "'## Context (not errors)'", "''",
            f"'- ' || {number('records_sharing_an_address')} || ' records share their address with another record, usually a "
            "`for_sale` and a `sold` record of the same home. Group by address before property-level modelling.'",
            "'- Share of records with no `prev_sold_date`, by status (missing is expected for unsold homes): ' || "
            "(SELECT string_agg(item || ' ' || printf('%.1f', 100 * value) || '%', ', ' ORDER BY item) FROM summary "
            "WHERE part = 'missing_prev_sold_date_by_status')"]
    return (f"{AUDIT}, {SUMMARY}, parts AS (SELECT list_concat(list_concat([{', '.join(head)}], {table}), [{', '.join(tail)}]) AS ls) "
            "SELECT CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM parts, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)")


# --- older rules ---------------------------------------------------------------------------------------------------------

SAME_PRICE = f"""sp AS (SELECT {names(LEGACY_PROPERTY_KEY)}, count(*) AS records FROM t WHERE {present(LEGACY_PROPERTY_KEY)}
  GROUP BY {names(LEGACY_PROPERTY_KEY)}
  HAVING count(*) > 1 AND count(day) > 1 AND date_diff('day', min(day), max(day)) > 365),
spr AS (SELECT t.* FROM t SEMI JOIN sp USING ({names(LEGACY_PROPERTY_KEY)}))"""
MANIPULATION = f"""pm AS (SELECT {names(LEGACY_HOME_KEY)}, count(*) AS records FROM t WHERE {present(LEGACY_HOME_KEY)}
  GROUP BY {names(LEGACY_HOME_KEY)}
  HAVING count(*) > 1 AND count(day) > 1 AND min(price) FILTER (day IS NOT NULL) = max(price) FILTER (day IS NOT NULL)
    AND count(*) FILTER (day IS NOT NULL AND price IS NULL) = 0 AND date_diff('day', min(day), max(day)) > 365),
pmr AS (SELECT t.* FROM t SEMI JOIN pm USING ({names(LEGACY_HOME_KEY)}))"""


def mixes(rows, key):
    per_status = f"SELECT {names(key)}, status AS member, count(*) AS n FROM {rows} GROUP BY ALL"
    written = "CASE WHEN n = 1 THEN member ELSE member || ' x ' || n END"
    return (f"SELECT CAST(sum(n) AS BIGINT) AS records, string_agg({written}, ' + ' ORDER BY member) AS mix "
            f"FROM ({per_status}) GROUP BY {names(key)}")


LIFECYCLE = f"""{SAME_PRICE}, pairs AS (SELECT *, date_diff('day', for_sale, sold) / 365.25 AS years FROM (
  SELECT max(day) FILTER (status = 'for_sale') AS for_sale, max(day) FILTER (status = 'sold') AS sold FROM spr
  GROUP BY {names(LEGACY_PROPERTY_KEY)}) WHERE for_sale IS NOT NULL AND sold IS NOT NULL)"""
ROLLUP = f"""{SAME_PRICE}, rollup AS (SELECT f.brokered_by, f.flagged_pairs, l.sold_listings, l.all_listings,
  {rnd("CASE WHEN l.sold_listings <> 0 THEN f.flagged_pairs / l.sold_listings END")} AS flags_per_sale
  FROM (SELECT brokered_by, count(*) AS flagged_pairs FROM sp GROUP BY brokered_by) f
  JOIN (SELECT brokered_by, count(*) FILTER (status = 'sold') AS sold_listings, count(*) AS all_listings FROM t
        GROUP BY brokered_by) l USING (brokered_by))"""


def spearman(table, a, b):
    return (f"SELECT count(*) AS n, {rnd('corr(ra, rb)')} AS rho FROM (SELECT "
            f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM {table})")


WINDOW = "w AS (SELECT min(day) AS first_sale, max(day) AS last_sale FROM t WHERE status = 'sold')"


# --- planting ------------------------------------------------------------------------------------------------------------

def planting():
    dated = r"regexp_full_match(prev_sold_date, '\d{4}-\d{2}-\d{2}')"
    swapped = "substr(prev_sold_date, 1, 2) || substr(prev_sold_date, 4, 1) || substr(prev_sold_date, 3, 1)"
    keyed = present(LISTING_KEY)
    half, near = SPEC.typo_years // 2, SPEC.near_duplicates // 2
    pools = [(dated, SPEC.sentinel_dates), (dated, half),
             (f"{dated} AND TRY_CAST({swapped} AS INT) > 2026", SPEC.typo_years - half),
             (keyed, SPEC.exact_duplicates), (keyed, near), (f"{keyed} AND price >= 1000", SPEC.near_duplicates - near),
             *[("price > 0", n) for n in SPEC.price_factors.values()]]
    steps, used = [f"h AS (SELECT *, {hash60(texts([str(SEED)]), 'rid')} AS u FROM t)"], []
    for i, (pool, n) in enumerate(pools):
        free = "".join(f" AND rid NOT IN (SELECT rid FROM s{j})" for j in used)
        steps.append(f"s{i} AS (SELECT rid FROM h WHERE {pool}{free} ORDER BY u LIMIT {n})")
        used.append(i)
    taken = " UNION ALL ".join(f"SELECT rid, {i} AS stage FROM s{i}" for i in used)
    steps.append(f"taken AS ({taken})")
    steps.append("m AS (SELECT h.*, taken.stage, (stage IN (3, 4, 5)) IS TRUE AS copied FROM h LEFT JOIN taken USING (rid))")
    factors = "".join(f" WHEN stage = {6 + i} THEN price * CAST({f} AS DOUBLE)" for i, f in enumerate(SPEC.price_factors))
    seed = texts([str(SEED)])
    sentinel = f"list_value('1900-01-01', '0000-00-00', '1970-01-01', 'unknown', 'N/A', '9999-12-31')[1 + {hash60(texts(['sentinel']), seed, 'rid')} % 6]"
    date = (f"CASE WHEN stage = 0 THEN {sentinel} WHEN stage = 1 THEN CAST(CAST(substr(prev_sold_date, 1, 4) AS INT) + 1000 AS VARCHAR)"
            f" || substr(prev_sold_date, 5) WHEN stage = 2 THEN {swapped} || substr(prev_sold_date, 5) ELSE prev_sold_date END")
    size = f"(0.001::DOUBLE + (0.005::DOUBLE - 0.001::DOUBLE) * ({hash60(texts(['size']), seed, 'rid')} / 1152921504606846976.0::DOUBLE))"
    up = f"{hash60(texts(['sign']), seed, 'rid')} % 2 = 1"
    repriced = f"CASE WHEN stage = 5 THEN round_even(price * (1 + CASE WHEN {up} THEN {size} ELSE -{size} END), 0) ELSE price END"
    lost = f"{hash60(texts(['blank']), seed, 'rid')} % 4"
    blank = {c: f"CASE WHEN stage = 4 AND {lost} = {i} THEN NULL ELSE {c} END" for i, c in
             enumerate(("bed", "bath", "acre_lot", "house_size"))}
    edited = {"price": f"CASE{factors} ELSE price END", "prev_sold_date": date}
    copied = {**blank, "price": repriced}
    columns = [c for c in LISTING_COLUMNS]

    def values(changes):
        return ", ".join(f"{changes.get(c, c)} AS {c}" for c in columns)

    steps.append(f"both_rows AS (SELECT rid, rid AS source_rid, stage, {values(edited)} FROM m UNION ALL "
                 "SELECT (SELECT max(rid) FROM t) + row_number() OVER (ORDER BY u) AS rid, rid AS source_rid, stage, "
                 f"{values(copied)} FROM m WHERE copied)")
    kinds = ["year +1000", "transposed year", "exact copy", "one attribute blanked", "price re-keyed (<=0.5%)",
             *[f"x{f:g}" for f in SPEC.price_factors]]
    subtype = "CASE stage WHEN 0 THEN 'sentinel ' || prev_sold_date " + " ".join(
        f"WHEN {i + 1} THEN {texts([k])}" for i, k in enumerate(kinds)) + " END"
    family = "CASE WHEN stage < 3 THEN 'invalid_date' WHEN stage < 6 THEN 'duplicate' ELSE 'price_unit' END"
    steps.append(f"lab AS (SELECT rid, source_rid, stage, {family} AS family, {subtype} AS subtype FROM both_rows WHERE stage IS NOT NULL)")
    return f"{base('recent')}, " + ", ".join(steps)


def planted_stage(*stages):
    chosen_stages = ", ".join(str(s) for s in stages)
    return (f"{planting()} SELECT b.rid, b.source_rid, lab.subtype, b.price, b.bed, b.bath, b.acre_lot, b.house_size, b.prev_sold_date "
            f"FROM both_rows b JOIN lab USING (rid) WHERE b.stage IN ({chosen_stages}) "
            "AND (b.stage NOT IN (3, 4, 5) OR b.rid <> b.source_rid)")


# --- scoring -------------------------------------------------------------------------------------------------------------

def metric_row(flags, pos, before=None):
    """SELECT of the flag metrics from CTEs flags (rid, flag) and pos (rid)."""
    pre = f", count(*) FILTER (flag AND NOT y AND rid IN (SELECT rid FROM {before})) AS pre" if before else ""
    upper = (f", pre AS fp_preexisting, {rnd('CASE WHEN tp + fp - pre <> 0 THEN tp / (tp + fp - pre) END')} AS precision_upper"
             if before else "")
    p, r = "tp / (tp + fp)", "tp / (tp + fn)"
    return (f"SELECT tp + fp AS flagged, tp, fp, fn, {rnd(f'CASE WHEN tp + fp <> 0 THEN {p} END')} AS precision, "
            f"{rnd(f'CASE WHEN tp + fn <> 0 THEN {r} END')} AS recall, "
            f"{rnd(f'CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END')} AS f1{upper} "
            f"FROM (SELECT count(*) FILTER (flag AND y) AS tp, count(*) FILTER (flag AND NOT y) AS fp, "
            f"count(*) FILTER (NOT flag AND y) AS fn{pre} FROM (SELECT rid, flag, rid IN (SELECT rid FROM {pos}) AS y FROM {flags}))")


DOCUMENTS = f"""WITH vals AS (SELECT doc_id AS rid, lang AS g, 'all' AS f, ['length'] AS measures, [ln(n_chars)] AS vs FROM documents),
{STATS}, sc AS (SELECT rid, round(coalesce(abs({Z}), 0.0), 6) AS score FROM ({chosen("length", False)})),
y AS (SELECT sc.*, CASE WHEN rid IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1 ELSE 0 END AS y FROM sc)"""


def curve(rows, part=""):
    """CTEs c: per score n, tp and both accumulated from the top."""
    by = f"{part}, " if part else ""
    over = f"PARTITION BY {part} " if part else ""
    return (f"c AS (SELECT *, sum(n) OVER ({over}ORDER BY score DESC) AS cn, sum(tp) OVER ({over}ORDER BY score DESC) AS ct, "
            f"sum(tp) OVER ({('PARTITION BY ' + part) if part else ''}) AS k FROM (SELECT {by}score, count(*) AS n, sum(y) AS tp FROM {rows} GROUP BY {by}score))")


AP = "sum(tp / k * ct / cn)"
RP = "sum(tp * greatest(0, least(n, k - (cn - n))) / n) / any_value(k)"

LABELLED = f"known AS ({LABELS})"
FOLDED = f"""{base()}, {LABELLED}, {price_z("plain", False)}, {price_z("floored", True, False)},
s AS (SELECT '{ROBUST}' AS detector, rid, round(price_z, 6) AS score FROM plain
      UNION ALL SELECT '{FLOORED}', rid, round(price_z, 6) FROM floored),
f AS (SELECT s.*, {hash60("'fold'", "rid")} % {FOLDS} AS seed, score > 3.5 AS flag,
        CASE WHEN rid IN (SELECT rid FROM known WHERE family = 'price_unit') THEN 1 ELSE 0 END AS y FROM s),
{curve("f", "detector, seed")},
ranks AS (SELECT detector, seed, {AP} AS average_precision, {RP} AS r_precision FROM c GROUP BY detector, seed),
counts AS (SELECT detector, seed, count(*) FILTER (flag AND y = 1) AS tp, count(*) FILTER (flag AND y = 0) AS fp,
             count(*) FILTER (NOT flag AND y = 1) AS fn FROM f GROUP BY detector, seed),
metrics AS (SELECT *, tp + fp AS flagged, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) END AS precision,
              CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) END AS recall,
              CASE WHEN tp + fp = 0 OR tp + fn = 0 THEN NULL WHEN tp = 0 THEN 0.0
                   ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1
            FROM counts JOIN ranks USING (detector, seed))"""


# --- leakage --------------------------------------------------------------------------------------------------------------

PREPARED = f"""kept AS (SELECT * FROM t WHERE price BETWEEN 10000 AND 50000000),
states AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS code FROM (SELECT DISTINCT state FROM kept WHERE state IS NOT NULL)),
statuses AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM kept WHERE status IS NOT NULL)),
prep AS (SELECT kept.*, ln(price) AS y, CAST(coalesce(a.code, -1) AS INT) AS state_code, CAST(coalesce(b.code, -1) AS INT) AS status_code,
   CAST(year(day) AS INT) AS sold_year, ({present(PROPERTY_KEY)}) AS known FROM kept
   LEFT JOIN states a USING (state) LEFT JOIN statuses b USING (status))"""
UNIT = "1152921504606846976.0::DOUBLE"


def splits(seeds):
    """CTE twins: seed x record with is_test, twin, seen."""
    values = ", ".join(f"({s})" for s in range(seeds))
    return f"""{base()}, {PREPARED}, sp1 AS (SELECT seed, prep.*, {hash60("'split'", "seed", "rid")} / {UNIT} < 0.2 AS is_test
  FROM prep, (VALUES {values}) v(seed)),
twins AS (SELECT *, known AND NOT is_test AND bool_or(is_test) OVER p AS twin,
    known AND is_test AND bool_or(NOT is_test) OVER p AS seen, {hash60("'keep'", "seed", "rid")} AS u
  FROM sp1 WINDOW p AS (PARTITION BY seed, {names(PROPERTY_KEY)}))"""


def training(seeds, shares):
    """CTEs up to trained: seed, keep_share and the training records."""
    values = ", ".join(f"({s}::DOUBLE)" for s in shares)
    return f"""{splits(seeds)}, sizes AS (SELECT seed, count(*) FILTER (twin) AS nt, count(*) FILTER (NOT twin) AS no FROM twins
  WHERE NOT is_test GROUP BY seed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, twin ORDER BY u) AS rn FROM twins WHERE NOT is_test),
trained AS (SELECT ranked.*, keep_share FROM ranked JOIN sizes USING (seed), (VALUES {values}) v(keep_share)
  WHERE CASE WHEN twin THEN rn <= round_even(keep_share * nt, 0) ELSE rn <= no - round_even(keep_share * nt, 0) END)"""


def predictions(seeds, shares):
    frames = " UNION ALL ".join(
        f"""SELECT te.seed, '{model}' AS model, m.keep_share, te.rid, te.seen, te.y, m.p FROM twins te
        JOIN (SELECT seed, keep_share, coalesce(CAST({by} AS VARCHAR), '?') AS g, avg(y) AS p FROM trained GROUP BY ALL) m
        ON m.seed = te.seed AND m.g = coalesce(CAST(te.{by} AS VARCHAR), '?') WHERE te.is_test"""
        for model, by in BASELINES.items())
    return f"{training(seeds, shares)}, pred AS ({frames})"


METRICS = """count(*) AS n_test, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2, avg(abs(p - y)) AS mae_log,
  median(abs(exp(p - y) - 1)) AS median_ape"""


def metric_rows(seeds, shares):
    return f"""{predictions(seeds, shares)}, metrics AS (SELECT seed, model, keep_share, subset, {METRICS} FROM (
  SELECT *, unnest(['all test rows', CASE WHEN seen THEN 'property seen in train' ELSE 'property not seen' END]) AS subset
  FROM pred) GROUP BY seed, model, keep_share, subset)"""


PAIRED = """pairs AS (SELECT model, seed, max(r2) FILTER (keep_share = 0) AS r0, max(r2) FILTER (keep_share = 1) AS r1,
  max(median_ape) FILTER (keep_share = 0) AS a0, max(median_ape) FILTER (keep_share = 1) AS a1
  FROM metrics WHERE subset = 'all test rows' GROUP BY model, seed)"""


def interval(value, n):
    return f"{t_critical(n - 1)!r} * stddev_samp({value}) / sqrt(count({value}))"


PID_TEXT = ("CASE WHEN known THEN concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in PROPERTY_KEY)
            + ") ELSE CAST(rid AS VARCHAR) END")


def grouped(seeds):
    """CTE gs: seed x record with is_test by property."""
    values = ", ".join(f"({s})" for s in range(seeds))
    return f"""pt AS (SELECT *, {PID_TEXT} AS ptext FROM prep),
gu AS (SELECT seed, ptext, row_number() OVER (PARTITION BY seed ORDER BY {hash60("'group'", "seed", "ptext")}) AS rn,
   count(*) OVER (PARTITION BY seed) AS n FROM (SELECT DISTINCT ptext FROM pt), (VALUES {values}) v(seed)),
gs AS (SELECT pt.*, gu.seed, gu.rn <= ceil(0.2 * gu.n) AS is_test FROM pt JOIN gu USING (ptext))"""


def naive():
    frames = " UNION ALL ".join(
        f"""SELECT te.seed, '{model}' AS model, '{split}' AS split, te.y, m.p FROM {table} te
        JOIN (SELECT seed, coalesce(CAST({by} AS VARCHAR), '?') AS g, avg(y) AS p FROM {table} WHERE NOT is_test GROUP BY ALL) m
        ON m.seed = te.seed AND m.g = coalesce(CAST(te.{by} AS VARCHAR), '?') WHERE te.is_test"""
        for model, by in BASELINES.items() for split, table in (("random", "twins"), ("grouped", "gs")))
    return (f"{grouped(SEEDS)}, nv AS (SELECT seed, model, split, {METRICS} FROM ({frames}) GROUP BY ALL), "
            "gaps AS (SELECT model, seed, max(r2) FILTER (split = 'random') - max(r2) FILTER (split = 'grouped') AS gap "
            "FROM nv GROUP BY model, seed)")


def same(columns, gaps_match):
    other = "OR a.{c} IS NULL OR b.{c} IS NULL" if gaps_match else "OR (a.{c} IS NULL AND b.{c} IS NULL)"
    return "bool_or(" + " AND ".join(f"(a.{c} = b.{c} {other.format(c=c)}) IS TRUE" for c in columns) + ")"


ANATOMY = f"""{splits(1)}, per AS (SELECT a.rid, count(*) AS n, {same(["bed", "bath", "house_size", "acre_lot"], True)} AS same_home,
  bool_or(a.price = b.price) AS same_price, {same(MODEL_FEATURES, False)} AS same_features
  FROM twins a JOIN twins b ON {" AND ".join(f"a.{c} = b.{c}" for c in PROPERTY_KEY)} WHERE a.seen AND b.twin GROUP BY a.rid)
SELECT count(*) AS test_rows_with_twin, {", ".join(
    f"{rnd(f'avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)')} AS {n}" for c, n in (
        ("n = 1", "one_twin"), ("same_home", "same_home"), ("same_price", "same_price"), ("same_features", "same_features")))}
FROM per"""

RAW_FEATURES = {
    "lp": "vs[2]", "lppsf": "vs[1]",
    "lp_rel": "vs[2] - (SELECT med FROM stats WHERE level = 'group' AND measure = 'price' AND key = CAST(vals.g AS VARCHAR))",
    "lppsf_rel": "vs[1] - (SELECT med FROM stats WHERE level = 'group' AND measure = 'per_size' AND key = CAST(vals.g AS VARCHAR))",
    "bed": "bed", "bath": "bath", "lacre": "ln(1 + acre_lot)"}
FOREST_FEATURES = f"""{base()}, {PRICE_VALS.replace("SELECT rid,", "SELECT rid, bed, bath, acre_lot,")}, {STATS},
raw_f AS (SELECT rid, {", ".join(f"{v} AS {k}" for k, v in RAW_FEATURES.items())} FROM vals)
SELECT rid, {", ".join(f"round(coalesce({k}, (SELECT median({k}) FROM raw_f)), 6) AS {k}" for k in RAW_FEATURES)},
{", ".join(f"CASE WHEN {k} IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS {k}_na" for k in RAW_FEATURES)} FROM raw_f"""

LINE_VALS = """vals AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS g, l_suppkey AS f, ['unit_price'] AS measures,
  [ln(l_extendedprice) - ln(l_quantity)] AS vs FROM lineitem)"""

STAGES = ["plant_sentinel_dates", "plant_year_plus_1000", "plant_transposed_year", "plant_exact_duplicates",
          "plant_blanked_duplicates", "plant_repriced_duplicates"]

ORACLES = {
    "scan_listings": f"""WITH listings AS ({LISTINGS}), q AS ({QUOTED})
      SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, {', '.join(
        f'TRY_CAST({c} AS DOUBLE) AS {c}' if kind == 'double' else c for c, kind in LISTING_TYPES.items())} FROM q""",
    "parsed_listings": raw_checks() + "SELECT " + ", ".join(
        f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in ("price", "bed", "house_size", "zip_code")) + " FROM t",
    "replace_partition_results": f"""WITH listings AS ({LISTINGS}), recent AS ({RECENT}),
      a AS (SELECT *, {day()} AS day FROM listings), b AS (SELECT *, {day()} AS day FROM recent)
      SELECT state, count(*) AS flags, 'original' AS model FROM a WHERE {PLACEHOLDER} GROUP BY state
      UNION ALL SELECT state, count(*), 'corrected' FROM b WHERE {INVALID} OR starts_with(prev_sold_date, '200') GROUP BY state""",
    "report_lines": report_lines(),
    "contract_coercion": raw_checks() + violations(COERCION),
    "contract_categories": raw_checks() + violations(CATEGORIES),
    "contract_ranges": f"{base()} {violations(RANGES)}",
    "contract_date_pattern": f"{base()} {violations(PATTERN)}",
    "contract_row_rules": f"{base()} {violations(ROWS)}",
    "expectation_report": f"{base()} {violations(RANGES + PATTERN + ROWS)}",
    "invalid_dates": f"{base()} SELECT rid, prev_sold_date FROM t WHERE {INVALID}",
    "listing_duplicates": f"{base()}, {DUPLICATES} SELECT rid FROM dups",
    "duplicate_key_sizes": f"""{base()} SELECT n AS group_size, count(*) AS keys, CAST(n * count(*) AS BIGINT) AS records,
      CAST(count(*) * n * (n - 1) / 2 AS DECIMAL(38, 0)) AS candidate_pairs
      FROM (SELECT count(*) AS n FROM t WHERE {present(LISTING_KEY)} GROUP BY {names(LISTING_KEY)}) GROUP BY n""",
    "isolation_forest_summary": f"{base()} SELECT count(*) AS records, count(*) AS in_range, true AS wrong_units_stand_out FROM t",
    "duplicate_links": f"""{base().replace("WITH", "WITH RECURSIVE", 1)}, pairs AS (SELECT a.rid, b.rid AS other FROM t a JOIN t b
      ON {" AND ".join(f"a.{c} = b.{c}" for c in LISTING_KEY)} AND a.rid <> b.rid WHERE {COMPATIBLE}),
      reach AS (SELECT rid, other FROM pairs UNION SELECT r.rid, p.other FROM reach r JOIN pairs p ON r.other = p.rid)
      SELECT rid, n_links, "group" FROM (SELECT rid, count(*) AS n_links FROM pairs GROUP BY rid)
      JOIN (SELECT rid, least(rid, min(other)) AS "group" FROM reach GROUP BY rid) USING (rid)""",
    "multi_key_records": f"""{base()} SELECT rid FROM (SELECT rid, count(*) OVER (PARTITION BY {names(LISTING_KEY)}) AS n FROM t
      WHERE {present(LISTING_KEY)}) WHERE n > 1""",
    "group_robust_stats": f"WITH {LINE_VALS}, {STATS} SELECT level, key, n, {rnd('med')} AS med, {rnd('mad')} AS mad FROM stats",
    "robust_stats_fallback": f"""{base()}, {PRICE_VALS}, {STATS} SELECT rid, {rnd('med')} AS med, {rnd('mad')} AS mad, fallback
      FROM ({chosen("per_size", False)})""",
    "mad_floor": f"{base()}, {PRICE_VALS}, {STATS} SELECT measure, {rnd('mad_floor')} AS mad_floor FROM floors",
    "modified_z": f"""WITH {LINE_VALS}, {STATS} SELECT l_orderkey, l_linenumber, l_partkey, {rnd(Z)} AS z
      FROM ({chosen("unit_price")})""",
    "price_robust_z": f"{base()}, {price_z()} SELECT rid, {FINITE6} AS price_z FROM scored",
    "price_robust_z_nofloor": f"{base()}, {price_z(floor=False)} SELECT rid, {FINITE6} AS price_z FROM scored",
    "price_outliers": f"{base()}, {price_z()} SELECT rid, price FROM scored WHERE price_z > 3.5 AND price <> 0",
    "iforest_features": FOREST_FEATURES,
    "property_ids": f"""{base()} SELECT n AS records_per_property, count(*) AS properties FROM (
      SELECT count(*) AS n FROM t GROUP BY {names(PROPERTY_KEY)}, CASE WHEN {present(PROPERTY_KEY)} THEN NULL ELSE rid END) GROUP BY n""",
    "records_sharing_address": f"""{base()} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS records, count(*) AS addresses FROM (
      SELECT count(*) AS n FROM t WHERE {present(PROPERTY_KEY)} GROUP BY {names(PROPERTY_KEY)}) WHERE n > 1""",
    "audit_flags": f"{AUDIT} SELECT rid, {names(FLAGS)}, {FINITE6} AS price_z FROM flagged",
    "audit_report": f"""{AUDIT} SELECT rid AS row, concat_ws(';', {", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in FLAGS)}) AS flags,
      {names(REPORT_COLUMNS)}, CASE WHEN isinf(price_z) THEN price_z ELSE round_even(price_z, 2) END AS price_z
      FROM flagged WHERE {ANY_FLAG}""",
    "audit_summary": f"""{AUDIT} SELECT count(*) FILTER ({ANY_FLAG}) AS records_flagged,
      {", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FLAGS)} FROM flagged""",
    "missing_rate_by_status": f"""{base()} SELECT status, round_even(avg(CASE WHEN prev_sold_date IS NULL THEN 1.0 ELSE 0.0 END), 4)
      AS missing_rate FROM t GROUP BY status""",
    "full_audit": f"{AUDIT}, {SUMMARY} SELECT part, item, detail, {rnd('value')} AS value FROM summary",
    "legacy_placeholder_dates": f"{base()} SELECT rid FROM t WHERE {PLACEHOLDER}",
    "legacy_same_price_dates": f"{base()}, {SAME_PRICE} SELECT rid FROM spr",
    "legacy_price_manipulation": f"{base()}, {MANIPULATION} SELECT rid FROM pmr",
    "plant_sample": f"""{base('recent')} SELECT rid, price FROM t WHERE price > 0 ORDER BY {hash60(texts([str(SEED)]), 'rid')} LIMIT 100""",
    **{name: planted_stage(i) for i, name in enumerate(STAGES)},
    "plant_price_units": planted_stage(6, 7, 8, 9),
    "plant_all": f"{planting()} SELECT b.rid, {names(LISTING_COLUMNS, 'b.')}, lab.family, lab.subtype FROM both_rows b LEFT JOIN lab USING (rid)",
    "flag_metrics": f"""{base()}, {DUPLICATES}, {LABELLED}, pos AS (SELECT DISTINCT rid FROM known WHERE family = 'duplicate'),
      flags AS (SELECT rid, rid IN (SELECT rid FROM dups) AS flag FROM t) {metric_row("flags", "pos")}""",
    "flag_metrics_upper": f"""{base('recent')}, {LABELLED}, pos AS (SELECT DISTINCT rid FROM known WHERE family = 'invalid_date'),
      pre_flags AS (SELECT rid FROM t WHERE {PLACEHOLDER}),
      flags AS (SELECT rid, ({INVALID} OR prev_sold_date IS NULL) AS flag FROM t) {metric_row("flags", "pos", "pre_flags")}""",
    "average_precision": f"{DOCUMENTS}, {curve('y')} SELECT {rnd(AP)} AS average_precision FROM c",
    "r_precision": f"{DOCUMENTS}, {curve('y')} SELECT {rnd(RP)} AS r_precision FROM c",
    "recall_by_subtype": f"""{base()}, {DUPLICATES}, {LABELLED} SELECT subtype,
      {rnd('avg(CASE WHEN rid IN (SELECT rid FROM dups) THEN 1.0 ELSE 0.0 END)')} AS recall
      FROM known WHERE family = 'duplicate' GROUP BY subtype""",
    "base_flag_counts": f"""{base()}, {DUPLICATES}, {SAME_PRICE}, {MANIPULATION}, {price_z("plain", False)}, {price_z("floored", True, False)}
      SELECT 'original: placeholder dates' AS detector, 'invalid_date' AS family, count(*) AS flags FROM t WHERE {PLACEHOLDER}
      UNION ALL SELECT 'corrected: invalid dates', 'invalid_date', count(*) FROM t WHERE {INVALID}
      UNION ALL SELECT 'original: same price, different dates', 'duplicate', count(*) FROM spr
      UNION ALL SELECT 'original: price manipulation', 'duplicate', count(*) FROM pmr
      UNION ALL SELECT 'corrected: listing duplicates', 'duplicate', count(*) FROM dups
      UNION ALL SELECT '{ROBUST}', 'price_unit', count(*) FROM plain WHERE price_z > 3.5
      UNION ALL SELECT '{FLOORED}', 'price_unit', count(*) FROM floored WHERE price_z > 3.5""",
    "validation_summary": f"""{FOLDED} SELECT 'price_unit' AS family, detector, {rnd('avg(precision)')} AS precision,
      {rnd('avg(precision)')} AS precision_upper, {rnd('avg(recall)')} AS recall, {rnd('avg(f1)')} AS f1 FROM metrics GROUP BY detector""",
    "subtype_pivot": f"""{FOLDED}, r AS (SELECT f.detector, f.seed, known.subtype, avg(CASE WHEN f.flag THEN 1.0 ELSE 0.0 END) AS recall
      FROM f JOIN known USING (rid) WHERE known.family = 'price_unit' GROUP BY ALL)
      SELECT 'price_unit' AS family, subtype, {rnd(f"avg(recall) FILTER (detector = '{ROBUST}')")} AS plain,
      {rnd(f"avg(recall) FILTER (detector = '{FLOORED}')")} AS floored FROM r GROUP BY subtype""",
    "seed_confidence_interval": f"""{FOLDED} SELECT 'price_unit' AS family, detector, {rnd('avg(recall)')} AS mean,
      {rnd(interval('recall', FOLDS))} AS half_width FROM metrics GROUP BY detector""",
    "compare_variants": f"""{FOLDED} SELECT detector, {rnd('avg(flagged)')} AS flags, {rnd('avg(recall)')} AS recall,
      {rnd('avg(precision)')} AS precision_upper, {rnd('avg(average_precision)')} AS average_precision,
      {rnd('avg(r_precision)')} AS r_precision FROM metrics GROUP BY detector""",
    "largest_z": f"""{base()}, {price_z("plain", False)}, {price_z("floored", True, False)}
      SELECT round((SELECT max(price_z) FROM plain WHERE price > 0), 4) AS without_floor,
             round((SELECT max(price_z) FROM floored WHERE price > 0), 4) AS with_floor""",
    "leakage_prepare": f"{base()}, {PREPARED} SELECT rid, {rnd('y')} AS y, state_code, status_code, sold_year FROM prep",
    "leakage_population": f"""{base()}, {PREPARED} SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS properties,
      {rnd('coalesce(sum(n) FILTER (n > 1), 0) / sum(n)')} AS sharing FROM (
      SELECT count(*) AS n FROM prep GROUP BY {names(PROPERTY_KEY)}, CASE WHEN known THEN NULL ELSE rid END)""",
    "random_split": f"{base()} SELECT rid, {hash60(texts(['split']), texts(['0']), 'rid')} / {UNIT} < 0.2 AS is_test FROM t",
    "twin_mask": f"{splits(1)} SELECT rid, is_test, twin, seen FROM twins",
    "matched_training_rows": f"{training(1, SHARES)} SELECT rid, twin, keep_share FROM trained",
    "design_matrix_forest": f"""{base()}, {PREPARED} SELECT rid, {", ".join(
        f"{rnd(f'coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM prep))')} AS {c}" for c in MODEL_FEATURES)},
      {", ".join(f"CAST(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS {c}_missing" for c in MODEL_FEATURES)} FROM prep""",
    "regression_metrics": f"""{metric_rows(1, SHARES)} SELECT seed, model, keep_share, subset, n_test, {rnd('r2')} AS r2,
      {rnd('mae_log')} AS mae_log, {rnd('median_ape')} AS median_ape FROM metrics""",
    "mechanism_table": f"""{predictions(1, [0.0, 1.0])}, wide AS (SELECT model, rid, seen, max(abs(p - y)) FILTER (keep_share = 0) AS e0,
      max(abs(p - y)) FILTER (keep_share = 1) AS e1 FROM pred GROUP BY model, rid, seen)
      SELECT model, CASE WHEN seen THEN 'twin in training' ELSE 'no twin' END AS seen, count(e1 - e0) AS n,
      {rnd('avg(e0)')} AS err_without, {rnd('avg(e1)')} AS err_with, {rnd('avg(e1 - e0)')} AS change FROM wide GROUP BY model, seen""",
    "grouped_split": f"{base()}, {PREPARED}, {grouped(1)} SELECT rid, is_test FROM gs",
    "paired_inflation": f"""{metric_rows(SEEDS, [0.0, 1.0])}, {PAIRED} SELECT model, {rnd('avg(r0)', 5)} AS r2_without,
      {rnd('avg(r1)', 5)} AS r2_with, {rnd('avg(r1 - r0)', 5)} AS inflation, {rnd(interval('r1 - r0', SEEDS), 5)} AS half_width,
      {rnd('avg(r1 - r0) / (stddev_samp(r1 - r0) / sqrt(count(*)))', 5)} AS t_statistic, {rnd('avg(a0)', 5)} AS ape_without,
      {rnd('avg(a1 - a0)', 5)} AS ape_change FROM pairs GROUP BY model""",
    "dose_response": f"""{metric_rows(SEEDS, SHARES)}, g AS (SELECT a.keep_share, a.r2 - b.r2 AS gain FROM metrics a JOIN metrics b
      ON a.seed = b.seed AND a.model = b.model AND a.subset = b.subset AND b.keep_share = 0
      WHERE a.subset = 'all test rows' AND a.model = 'zip mean')
      SELECT keep_share, {rnd('avg(gain)')} AS gain, {rnd(interval('gain', SEEDS))} AS half_width,
      {rnd('(SELECT regr_slope(gain, keep_share) FROM g)')} AS slope,
      {rnd('(SELECT regr_intercept(gain, keep_share) FROM g)')} AS intercept FROM g GROUP BY keep_share""",
    "twin_anatomy": ANATOMY,
    "design_comparison": f"""{metric_rows(SEEDS, [0.0, 1.0])}, {PAIRED}, {naive()},
      a AS (SELECT model, avg(gap) AS nm, stddev_samp(gap) AS ns FROM gaps GROUP BY model),
      b AS (SELECT model, avg(r1 - r0) AS pm, stddev_samp(r1 - r0) AS ps FROM pairs GROUP BY model)
      SELECT model, {rnd('nm', 5)} AS naive_mean, {rnd('ns', 5)} AS naive_sd, {rnd('pm', 5)} AS paired_mean, {rnd('ps', 5)} AS paired_sd,
      {rnd('ns / ps', 5)} AS sd_ratio FROM a JOIN b USING (model)""",
    "headline_share": f"""{base()}, {SAME_PRICE}, {MANIPULATION}, n AS (SELECT (SELECT count(*) FROM t) AS records,
      (SELECT count(*) FROM t WHERE {PLACEHOLDER}) AS placeholder_records, (SELECT count(*) FROM sp) AS same_price_groups,
      (SELECT count(*) FROM spr) AS same_price_records, (SELECT count(*) FROM pm) AS manipulation_groups)
      SELECT *, {rnd('(placeholder_records + same_price_records) / records')} AS share FROM n""",
    "nonnull_placeholder_hits": f"{base()} SELECT count(*) AS nonnull_hits FROM t WHERE {PLACEHOLDER} AND prev_sold_date IS NOT NULL",
    "missing_by_status": f"""{base()} SELECT status, {rnd('avg(CASE WHEN prev_sold_date IS NULL THEN 1.0 ELSE 0.0 END)')} AS share,
      count(*) FILTER (prev_sold_date IS NULL) AS missing, count(*) AS records FROM t GROUP BY status""",
    "status_mix": f"{base()}, {SAME_PRICE} SELECT mix, count(*) AS groups FROM ({mixes('spr', LEGACY_PROPERTY_KEY)}) GROUP BY mix",
    "status_mix_manipulation": f"{base()}, {MANIPULATION} SELECT mix, count(*) AS groups FROM ({mixes('pmr', LEGACY_HOME_KEY)}) GROUP BY mix",
    "lifecycle_pairs": f"""{base()}, {LIFECYCLE}, {WINDOW} SELECT count(*) AS pairs,
      {rnd('avg(CASE WHEN sold BETWEEN first_sale AND last_sale THEN 1.0 ELSE 0.0 END)')} AS sold_in_window,
      {rnd('avg(CASE WHEN for_sale < sold THEN 1.0 ELSE 0.0 END)')} AS for_sale_older, {rnd('median(years)')} AS median_years
      FROM pairs, w""",
    "holding_histogram": f"""{base()}, {LIFECYCLE} SELECT CAST(least(floor(least(years, 40)), 39) AS INT) AS years_from, count(*) AS pairs
      FROM pairs WHERE years >= 1 GROUP BY 1""",
    "silently_dropped": f"""{base()}, g AS (SELECT count(*) AS n, ({present(LEGACY_PROPERTY_KEY)}) AS complete FROM t
      GROUP BY {names(LEGACY_PROPERTY_KEY)} HAVING count(*) > 1)
      SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS in_groups, CAST(coalesce(sum(n) FILTER (complete), 0) AS BIGINT) AS visible,
      CAST(coalesce(sum(n) FILTER (NOT complete), 0) AS BIGINT) AS dropped FROM g""",
    "detector_overlap": f"""{base()}, {SAME_PRICE}, {MANIPULATION} SELECT count(*) AS records,
      count(*) FILTER (rid IN (SELECT rid FROM spr)) AS also_same_price,
      {rnd('avg(CASE WHEN rid IN (SELECT rid FROM spr) THEN 1.0 ELSE 0.0 END)')} AS share FROM pmr""",
    "broker_rollup": f"{base()}, {ROLLUP} SELECT * FROM rollup",
    "spearman": f"{base()}, {ROLLUP} {spearman('rollup', 'flagged_pairs', 'sold_listings')}",
    "spearman_customers": f"""WITH c AS (SELECT c_acctbal, orders FROM customer JOIN (SELECT o_custkey, count(*) AS orders FROM orders
      GROUP BY o_custkey) ON o_custkey = c_custkey) {spearman('c', 'orders', 'c_acctbal')}""",
    "top_brokers": f"""{base()}, {ROLLUP}, big AS (SELECT brokered_by FROM t WHERE brokered_by IS NOT NULL GROUP BY brokered_by
      ORDER BY count(*) DESC, brokered_by LIMIT 3)
      SELECT *, brokered_by IN (SELECT brokered_by FROM big) AS among_largest FROM (
        SELECT * FROM rollup ORDER BY flagged_pairs DESC, brokered_by LIMIT 3)""",
    "review_tallies": f"""{base()}, {WINDOW}, mx AS (SELECT * FROM ({mixes('t', LEGACY_PROPERTY_KEY)}) WHERE records > 1)
      SELECT (SELECT count(*) FROM mx WHERE mix = 'for_sale + sold') AS lifecycle_groups,
      (SELECT count(*) FROM mx WHERE NOT (contains(mix, 'sold') AND contains(mix, 'for_sale'))) AS same_status_groups,
      count(*) FILTER (prev_sold_date IS NOT NULL AND day IS NULL) AS unparseable,
      count(*) FILTER (day < DATE '1950-01-01') AS before_1950, count(*) FILTER (day > last_sale) AS after_window FROM t, w""",
    "lifecycle_records": f"""{base()} SELECT CAST(coalesce(sum(records), 0) AS BIGINT) AS records FROM ({mixes('t', LEGACY_PROPERTY_KEY)})
      WHERE mix = 'for_sale + sold'""",
    "duplicate_review": f"""{base()}, {DUPLICATES}, d AS (SELECT t.* FROM t SEMI JOIN dups USING (rid))
      SELECT count(*) AS records, CAST(sum({" + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in [*COMPARED, "price"])}) AS BIGINT)
      AS filled_fields, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES)},
      (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY {names([*LISTING_KEY, *COMPARED, "price"])}
        HAVING count(*) > 1)) AS exact_copies,
      (SELECT count(*) FROM (SELECT DISTINCT {names(LISTING_KEY)} FROM d)) AS groups FROM d""",
    "zero_price_by_status": f"{base()} SELECT status, count(*) AS records FROM t WHERE price = 0 GROUP BY status",
    "top_price_outliers": f"""{base()}, {price_z()} SELECT rid, price, house_size, {FINITE6} AS price_z FROM scored WHERE price > 0
      ORDER BY {FINITE6} DESC, rid LIMIT 5""",
}
