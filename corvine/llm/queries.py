"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import ann, decontaminate, langid, license, mixing, neardup, pii, substrings, toxicity, urlfilter
from corvine.llm.tables import table


# The rules that the contract of this query names.
URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("candidates")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"), license.digests(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_substrings": op1_substrings, "op2_neardup": op2_neardup, "op9_neighbours": op9_neighbours, "op6_decontamination": op6_decontamination, "op3_mixing": op3_mixing, "op4_pii": op4_pii, "op5_urls": op5_urls, "op8_license": op8_license, "op7_language": op7_language, "op10_toxicity": op10_toxicity}


def _urls_sql() -> str:
    """Each rule as a predicate, longest first."""
    order = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in order]
    rule = " ".join(f"WHEN {w} THEN '{r.text}'" for w, r in zip(fits, order, strict=True))
    verdict = " ".join(f"WHEN {w} THEN '{r.verdict}'" for w, r in zip(fits, order, strict=True))
    return rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""


def _license_sql() -> str:
    """The canonical form spelt out in SQL, for documents and known texts alike."""

    def canonical(text: str) -> str:
        x = f"lower(coalesce({text}, ''))"
        x = rf"regexp_replace({x}, '(?m)^[^\p{{L}}\p{{N}}\n]*all rights reserved[^\p{{L}}\p{{N}}\n]*$', ' ', 'g')"
        # Lines that go on with "notice" and the like are marked first, so that they stay.
        x = rf"regexp_replace({x}, '(?m)^([^\p{{L}}\p{{N}}\n(©]*copy)(right[^\p{{L}}\p{{N}}\n]*(?:$|(?:notices?|holders?|owners?)(?:[^\p{{L}}\p{{N}}]|$)))', '\1' || chr(1) || '\2', 'g')"
        x = rf"replace(regexp_replace({x}, '(?m)^[^\p{{L}}\p{{N}}\n(©]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g'), chr(1), '')"
        x = rf"' ' || regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
        for variant, same in license.SPELLINGS:
            x = f"replace({x}, ' {variant.replace(' ', '  ')} ', ' {same} ')"
        return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"

    files = ", ".join(f"('{d}', '{k}')" for k, d in license.KNOWN_DIGESTS)
    rows = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(license.KNOWN))
    return f"""
WITH known AS (
  SELECT sha256({canonical("text")}) AS digest, min_by(license, ord) AS license
  FROM (VALUES {rows}) AS k(ord, license, text) GROUP BY 1
  UNION ALL VALUES {files}),
own AS (SELECT doc_id, sha256({canonical("text")}) AS digest FROM documents)
SELECT doc_id, own.digest, license FROM own LEFT JOIN known ON own.digest = known.digest AND known.digest <> sha256('')"""


def _substrings_sql() -> str:
    """Every string of LENGTH bytes as hex digits, cut from pieces of a hundred starts, with the least id that has it; then runs of removed starts."""
    n = substrings.LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
o AS (SELECT doc_id, hx, greatest(length(hx) // 2 - {n - 1}, 0) AS many, unnest(range((greatest(length(hx) // 2 - {n - 1}, 0) + 99) // 100)) AS o FROM d),
b AS (SELECT doc_id, 100 * o AS o, substr(hx, 200 * o + 1, {198 + 2 * n}) AS part, many FROM o),
p AS (SELECT doc_id, o, part, unnest(range(least(100, many - o))) AS r FROM b),
s AS (SELECT doc_id, o + r AS p, substr(part, 2 * r + 1, {2 * n}) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
g AS (SELECT doc_id, p FROM s JOIN f USING (k) WHERE first < doc_id),
r AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {n}, true)::INT AS new FROM g),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
x AS (SELECT doc_id, min(p) AS a, max(p) + {n} AS b FROM i GROUP BY doc_id, run),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM x),
z AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(hx, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)"""


ORACLES: dict[str, str] = {"op1_substrings": _substrings_sql(), "op5_urls": _urls_sql(), "op8_license": _license_sql()}
