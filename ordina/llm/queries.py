"""The thin opN_<name> queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, common, exact_dedup, html_extract, licenses, minhash, mixing, packing, quality_rules, substring, token_counts

_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: The mixture of op4 and of the pipeline: the crawl and curated sources, languages within them, sources within those.
LEVELS = {"domain": "CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END", "lang": "lang", "source": "source"}
WEIGHTS = {("crawl",): 0.4, ("curated",): 0.6} | {(d, *x): w for d in ("crawl", "curated") for *x, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))}


#: A tree of files for the documents: half of those that speak of a license are licence files in the two upper levels of
#: directories, all others stand in the two below.
_PATH = """concat_ws('/', source, CASE WHEN doc_id % 4 = 0 AND contains(coalesce(text, ''), 'icense') THEN concat('LICENSE-', doc_id)
    WHEN doc_id % 2 = 0 AND contains(coalesce(text, ''), 'icense') THEN concat_ws('/', lang, concat('COPYING.', doc_id))
    WHEN doc_id % 10 = 3 THEN concat_ws('/', lang, CAST(floor(doc_id / 1000) AS BIGINT), concat(doc_id, '.txt'))
    ELSE concat_ws('/', lang, CAST(floor(doc_id / 1000) AS BIGINT), doc_id % 3, concat(doc_id, '.txt')) END)"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"), LEVELS, WEIGHTS)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(common.table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    rows = classifier.features(documents)
    return classifier.score_on(rows, classifier.train_on(rows, common.table(spark, sf_dir, "labels")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = licenses.scan(documents.select(F.expr(_PATH).alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"([0-9]+)(\.txt)?$", 1).cast("long").alias("doc_id"), *found.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(common.table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(common.table(spark, sf_dir, "documents"), shingle=4)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(common.table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_license_scans, op3_exact_dedup, op4_mixing, op5_html_extraction, op6_minhash, op7_quality_rules, op8_quality_classifier, op9_substring_dedup, op10_packing)}


def _license_sql() -> str:
    rows, unknown = licenses.vectors()
    values = ", ".join(f"('{name}', {i}, '{term}', {weight!r}::DOUBLE, {idf!r}::DOUBLE)" for name, i, term, weight, idf in rows)
    line, paragraph = (licenses._ENDS[k] for k in ("line", "paragraph"))
    return f"""
        WITH t(license, template, term, weight, idf) AS (VALUES {values}),
        idf AS (SELECT DISTINCT term, idf FROM t),
        p AS (SELECT doc_id, {_PATH} AS path, lower(coalesce(text, '')) AS low FROM documents),
        d AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, low FROM p),
        b AS (SELECT doc_id, 'line' AS kind, unnest(string_split(low, chr(10))) AS x FROM d UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(low, '{licenses._PARAGRAPH}')) FROM d),
        e AS (SELECT doc_id, kind, unnest(CASE kind WHEN 'line' THEN regexp_split_to_array(x, '{line}') ELSE regexp_split_to_array(x, '{paragraph}') END) AS s FROM b),
        l AS (SELECT doc_id, kind, s, row_number() OVER () AS pos FROM e WHERE kind = 'line' OR contains(s, chr(10))),
        w AS (SELECT doc_id, kind, pos, unnest(regexp_extract_all(s, '[a-z0-9]+')) AS term FROM l),
        tf AS (SELECT doc_id, kind, pos, term, count(*) AS n FROM w GROUP BY ALL),
        norm AS (SELECT pos, sqrt(sum(n * n * coalesce(idf * idf, {unknown!r}))) AS norm, sum(n) AS terms FROM tf LEFT JOIN idf USING (term) GROUP BY ALL),
        dot AS (SELECT doc_id, kind, pos, license, template, sum(n * idf * weight) AS dot FROM tf JOIN t USING (term) GROUP BY ALL),
        hit AS (SELECT doc_id, kind, pos, max(struct_pack(s := round(dot / norm, 6), l := license)) AS b, any_value(terms) AS terms FROM dot JOIN norm USING (pos) WHERE round(dot / norm, 6) >= {licenses.COSINE} GROUP BY ALL),
        own AS (SELECT doc_id, max(b) AS b, greatest(coalesce(sum(terms) FILTER (kind = 'line'), 0), coalesce(sum(terms) FILTER (kind = 'paragraph'), 0)) AS covered FROM hit GROUP BY 1),
        f AS (SELECT d.doc_id, d.dir, path, b.l AS license, b.s AS score, regexp_matches(path, '/(LICENSE|COPYING)[^/]*$') OR covered >= {licenses.COVERAGE} * len(regexp_extract_all(low, '[a-z0-9]+')) AS grants FROM d LEFT JOIN own USING (doc_id)),
        g AS (SELECT dir AS up_dir, arg_min(license, (-score, path)) AS up, arg_min(score, (-score, path)) AS up_score FROM f WHERE license IS NOT NULL AND grants GROUP BY 1),
        a AS (SELECT dir, unnest(list_concat([''], list_transform(range(1, len(string_split(dir, '/')) + 1), lambda i: array_to_string(string_split(dir, '/')[1:i], '/')))) AS up_dir FROM (SELECT DISTINCT dir FROM f)),
        n AS (SELECT dir, max(struct_pack(n := length(up_dir), d := up_dir, l := up, s := up_score)) AS u FROM a JOIN g USING (up_dir) GROUP BY 1)
        SELECT doc_id, path, coalesce(license, u.l) AS license, coalesce(score, u.s) AS score,
            CASE WHEN license IS NOT NULL THEN 'own' WHEN u.l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
            CASE WHEN license IS NULL THEN u.d END AS license_dir
        FROM f LEFT JOIN n USING (dir)"""


_WORD_LIST = "regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def oracle_sql() -> dict[str, str]:
    lower_words, words = _WORD_LIST.format(text=_ASCII), _WORD_LIST.format(text="coalesce(text, '')")
    return {
        "op2_license_scans": _license_sql(),
        "op3_exact_dedup": f"""
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
            FROM (SELECT doc_id, {_ASCII} AS norm FROM documents) WINDOW w AS (PARTITION BY norm)""",
        "op6_minhash": f"""
            WITH RECURSIVE d AS (SELECT doc_id, {lower_words} AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x
                  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
            r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
            SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
            FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
        "op9_substring_dedup": f"""
            WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents),
            x AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
            c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM x) WHERE n > 1),
            g AS (SELECT r, list(DISTINCT pos) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS pos FROM c) GROUP BY 1),
            k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda pos: NOT list_contains(gone, pos)))) END AS kept FROM d LEFT JOIN g USING (r))
            SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    }
