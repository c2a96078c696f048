"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores the failure bits beside the measurements. Policies are
versioned masks over those bits, so applying one, comparing two, or asking what a rule alone costs (``ablation``) never
reads a text again. Everything is row-local: no shuffle but for the bounded bit histogram of an ablation.

Nulls and edges: a null or empty text has no words and fails ``min_words``; ties do not arise; repeated rows are judged
each on its own; an empty table gives an empty ledger; further columns are passed on by ``ledger(..., keep=...)`` only.
Three-word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, words

#: (name, SQL condition under which the rule fails), in bit order. Integer arithmetic only, so that engines agree.
RULES: tuple[tuple[str, str], ...] = (
    ("min_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_bangs > n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["min_words"] | BIT["repeat_words"]


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the rules in ``mask``."""

    version: str
    mask: int


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("2024-1", sum(BIT.values())))}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs")


def _covered(windows: Column) -> Column:
    """Positions under a three-word window whose hash occurs twice or more in the array."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the array is bound to a lambda variable, so that it is sorted once
    twice = F.transform(
        F.array(tagged),
        lambda s: F.sort_array(
            F.transform(
                F.filter(s, lambda e, i: (e["h"] == F.coalesce(F.get(s, i - 1)["h"], F.bitwise_not(e["h"]))) | (e["h"] == F.coalesce(F.get(s, i + 1)["h"], F.bitwise_not(e["h"])))),
                lambda e: e["i"],
            )
        ),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
    return F.aggregate(F.get(twice, F.lit(0)), start, step, lambda a: a["n"])


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` (``_in`` behind names that are measurements), the measurements and ``fail_bits`` (bit i: rule i fails)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    passed, out = kept(keep, ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs", "fail_bits"))
    a = df.select(passed, body.alias("__t"), words(F.col(text)).alias("__w"), lines.alias("__l"))
    b = a.withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    n = F.size("__w")
    c = b.withColumn(
        "__g",
        F.transform(F.slice("__h", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(F.col("__h"), i + 1), F.get(F.col("__h"), i + 2))),
    )
    measured = c.select(
        "__kept",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__g")) == F.size("__g"), F.lit(0).cast("long")).otherwise(_covered(F.col("__g"))).alias("n_repeat_words"),
        F.length(F.regexp_replace("__t", r"[^!]+", "")).cast("long").alias("n_bangs"),
    )
    bits = " + ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES)
    judged = measured.withColumn("fail_bits", F.expr(bits).cast("long"))
    return judged.select(F.struct(*[c for c in judged.columns if c != "__kept"]).alias("__own"), "__kept").select(*out, "__own.*")


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and ``policy`` (its version)."""
    return rows.withColumns({"kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0, "policy": F.lit(policy.version)})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, and documents that only this rule removes.

    The bits are first counted (at most 2^rules rows), so the measure costs one small shuffle at any size.
    """
    histogram = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name, _ in RULES if BIT[name] & policy.mask])
    spread = histogram.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return spread.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit & (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("failed_alone"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["2024-1"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, (""" + " + ".join(f"(CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END)" for name, rule in RULES) + f""")::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES["2024-1"].mask}) = 0 AS kept, fail_bits FROM f
"""
