"""Line dedup as an exact set-similarity join.

A line is the set of its words. A line is removed if an earlier line (by doc_id, then line number), kept or not, has a
Jaccard similarity of at least ``percent``. Lines without words stay.

1. Tokens get one order over the table, rarest first: by frequency in 2^20 hash buckets, then by hash. Any total order
   makes the prefix filter exact; the buckets only steer it, so their table has a fixed size. It is counted on the
   words of all lines, which are split and hashed once and kept as numbers for this and for the join.
2. Equal sets, by hash, size and parity bits, form a class, known by its first line.
3. A first pass deals with large groups of near copies: classes are held against an earliest class that has one of their
   last prefix tokens, where many have it. Most of a group is settled so, and what is settled meets no other class.
4. All other classes are listed under their prefix tokens and joined with all earlier classes by token, with prefix filter
   (the shorter line's prefix is the shorter one of PPJoin), length filter, positional filter and a parity filter: bits
   that each word of a line flips differ in at most as many places as the sets have words not in common.
5. Candidates are verified on their words in two waves: each open class first meets the earlier class with which it shares
   most prefix tokens, and only what stays open meets its other candidates. A line goes if it is not the first of its
   class, or if its class has a link to an earlier one.

All steps are DataFrame operations on hashed keys; only candidates fetch words again.

Nulls and edges: a null text has one line without words and keeps it (as null); rows with a null doc_id are left alone
and match nothing; rows that repeat a doc_id are rows of their own, in order of a hash of their texts, so of two equal rows one
keeps its lines; ties do not arise as positions differ; an empty table removes nothing; further columns, whatever their
names, are passed on by ``drop_lines``. ``later_matches`` itself asks for ids that do not repeat (``common.by_row`` makes some).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_row, cut, discard, fresh, store, table, tidy

BUCKETS, ROW = 1 << 20, 1 << 10
#: ``rarity`` counts one document of so many, and each that has over LONG bytes: a table of few documents has long ones.
SAMPLE, LONG = 16, 1 << 16
PERCENT = 80
#: Classes that share a prefix token from which on the first pass holds them against the earliest one.
MANY = 256
#: Tokens at the end of the prefix, the most frequent ones in it, that the first pass looks at.
LAST = 4
#: Lines of more words have 128 parity bits in place of 64.
SHORT = 64
#: Parts into which prefix tokens fall for the candidate join.
PARTS = 2


def _split(line: Column) -> Column:
    """The words of a line; white space other than blanks is rare and made blanks first."""
    odd = F.lit(False)
    for x in "\t\x0b\x0c\r":
        odd = odd | line.contains(x)
    return F.array_remove(F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " "), "")


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1))


def _lines(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """One row (columns, line, s) per line that is not all blanks. The filter looks at the string, as one on its words would be made twice."""
    split = df.select(*columns, F.posexplode(F.split(text, "\n")).alias("line", "s"))
    return split.filter(F.trim("s") != "")


def rarity(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``levels_of`` a sample of documents, for an order that need not be looked at closely; the join counts all lines."""
    sample = df.filter((F.pmod(F.xxhash64(doc_id), F.lit(SAMPLE)) == 0) | (F.octet_length(text) > LONG))
    return levels_of(hashes(sample, text, doc_id))


def levels_of(hashed: DataFrame) -> DataFrame:
    """One row, an array: by bucket a measure, in the highest byte, that grows with how many lines (h) have its words."""
    # counted before buckets without words come in, so that a task counts words as it unfolds them
    seen = hashed.select(F.explode("h").alias("word")).groupBy(_bucket(F.col("word")).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    none = hashed.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    # dealt by row once, for both of the groupings
    every = seen.union(none).withColumn("row", (F.col("bucket") / ROW).cast("int")).repartition("row")
    counts = every.groupBy("row", "bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.floor(F.log2(F.col("n") + 1) * 4), F.lit(127)).cast("tinyint")
    rows = counts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("bucket", level.alias("level")))).alias("x"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("row", F.col("x.level").alias("levels")))).alias("y")).select(F.transform(F.flatten("y.levels"), lambda x: F.shiftleft(x.cast("long"), 56)).alias("levels"))


def hashes(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, line, h) of lines that are not all blanks: the hashes of their words, each once."""
    hashed = F.array_distinct(F.transform(_split(F.col("s")), lambda x: F.xxhash64(x)))
    return _lines(df, text, F.col(doc_id).alias("doc_id")).select("doc_id", "line", hashed.alias("h"))


def need(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("int")


def common_words(n: Column, percent: int) -> Column:
    """Least number of common words of two sets with n words in all."""
    return F.ceil(n * percent / F.lit(100.0 + percent) - 1e-9).cast("int")


def lines(hashed: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line, k, n, prefix, p1, p2) of the lines of ``hashes``, some without words (n = 0); p1: 64 parity bits; p2: of lines over SHORT words, the bits that half of the words flip."""
    levels = cut(levels_of(hashed))
    h = hashed.select("*", levels.select("levels").scalar().alias("levels"))

    def token(x: Column) -> Column:
        # there is a level for each bucket; numbers that are never null are sorted as plain ones
        return F.coalesce(F.col("levels")[_bucket(x)] + F.shiftrightunsigned(x, 8), F.lit(0).cast("long"))

    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]

    def parity(flips: list[int]) -> Column:
        """What the words flip, each the entry under its last bits."""
        table = F.array(*[F.lit(x).cast("long") for x in flips])
        return F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(table[x.bitwiseAND(F.lit(len(flips) - 1))]))

    t = h.select("doc_id", "line", F.sort_array(F.transform("h", token)).alias("t"))
    n = F.size("t")
    linked = (n * 100 >= (n + 1) * percent) | (need(n, percent) < n)
    listed = F.transform(F.slice("t", F.lit(1), n - need(n, percent) + 1), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    return t.select(
        "doc_id", "line", F.xxhash64("t").alias("k"), n.alias("n"), F.when(linked, listed).alias("prefix"),
        parity(bits).alias("p1"),
        F.when(n > SHORT, parity([0] * 64 + bits)).otherwise(F.lit(0).cast("long")).alias("p2"),
    )


def _may_link(percent: int, a: str, b: str) -> Column:
    """Length and parity filters on columns n, p1, p2 of two sides."""
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    apart = na + nb - 2 * common_words(na + nb, percent)
    p1, p2 = (F.col(f"{p}_{a}").bitwiseXOR(F.col(f"{p}_{b}")) for p in ("p1", "p2"))
    # of two long lines, 128 bits in halves
    differ = F.when(F.least(na, nb) > SHORT, F.bit_count(p1.bitwiseXOR(p2)) + F.bit_count(p2)).otherwise(F.bit_count(p1))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (differ <= apart)


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}_{side}") for c in columns])


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"doc_id_{a}") < F.col(f"doc_id_{b}")) | ((F.col(f"doc_id_{a}") == F.col(f"doc_id_{b}")) & (F.col(f"line_{a}") < F.col(f"line_{b}")))


def _pair() -> list[Column]:
    return [F.struct(F.col(f"doc_id_{x}").alias("doc_id"), F.col(f"line_{x}").alias("line")).alias(x) for x in "ab"]


def _to_earliest(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, common): b and an earliest class a (by doc_id) of one of the last prefix tokens of b that at least MANY have
    there, and how many such tokens say so. At most LAST rows a class, whatever the size of a group.
    """
    columns = ("doc_id", "line", "n", "p1", "p2")
    ends = F.slice("prefix", F.greatest(F.size("prefix") - (LAST - 1), F.lit(1)), LAST)
    # counted by themselves first, as most tokens are not in so many classes
    counts = classes.select(F.explode(ends).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    many, path = store(counts.filter(F.col("c") >= MANY))
    flat = classes.select(*columns, F.explode(ends).alias("token")).join(many.filter(F.col("c") >= MANY).select("token"), "token")
    # plain numbers, so that tasks combine them in hash tables before the shuffle
    hubs = flat.groupBy("token").agg(F.min("doc_id").alias("doc_id_a"), *[F.min_by(c, "doc_id").alias(f"{c}_a") for c in columns[1:]])
    met = flat.transform(_side, "b", *columns).join(hubs, "token").filter(_earlier("a", "b") & _may_link(percent, "a", "b"))
    near = cut(met.groupBy("doc_id_a", "line_a", "doc_id_b", "line_b").agg(F.count("*").alias("common")).select(*_pair(), "common"))
    discard(classes.sparkSession, path)
    return near


def _candidates(flagged: DataFrame, percent: int, part: int) -> DataFrame:
    """(a, b, common): classes b that are open, earlier classes a that share so many of this part's prefix tokens and pass the filters."""
    columns = ("doc_id", "line", "n", "at", "p1", "p2", "open")
    flat = flagged.select("doc_id", "line", "n", "p1", "p2", "open", F.posexplode("prefix").alias("at", "token")).filter(F.pmod("token", F.lit(PARTS)) == part)
    # s is the shorter one, of equal ones the earlier; of it a shorter prefix is enough, so no pair is met from both sides
    head = flat.filter(F.col("at") <= F.col("n") - common_words(F.col("n") * 2, percent))
    pairs = head.transform(_side, "s", *columns).join(flat.transform(_side, "l", *columns), "token")
    ns, nl, at_s, at_l = (F.col(c) for c in ("n_s", "n_l", "at_s", "at_l"))
    # before a common token there is room for as many as the lesser place says, from it on for what the lesser rest says
    room = F.least(at_s, at_l) + F.least(ns - at_s, nl - at_l) >= common_words(ns + nl, percent)
    first = _earlier("s", "l")
    is_open = F.when(first, F.col("open_l")).otherwise(F.col("open_s"))
    met = pairs.filter((ns <= nl) & (nl * percent <= ns * 100) & _may_link(percent, "s", "l") & room & ((ns < nl) | first) & (first | _earlier("l", "s")) & is_open)
    keys = [F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{z}") for z, x, y in (("a", "s", "l"), ("b", "l", "s")) for c in ("doc_id", "line")]
    return met.groupBy(*keys).agg(F.count("*").alias("common")).select(*_pair(), "common")


def _words_of(df: DataFrame, text: str, doc_id: str, pairs: DataFrame) -> tuple[DataFrame, str]:
    """(p, w), the distinct words of the lines that stand in pairs, as a table, and its path."""
    both = pairs.select("a").union(pairs.select("b")).distinct().groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.collect_set("a.line").alias("wanted"))
    # as a table, its size is known to the planner, which then sends it to the texts or keeps other texts out of the exchange
    # by a Bloom filter; for one it asks for a condition
    wanted, path = store(both)
    wanted = wanted.filter(F.size("wanted") > 0)
    # lines are split behind the join, as whole texts take less room in an exchange
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("s")).join(wanted, "doc_id").select("doc_id", "wanted", F.split("s", "\n").alias("s"))
    whole = texts.groupBy("doc_id").agg(F.first("wanted").alias("wanted"), F.max_by("s", F.size("s")).alias("s"))
    rows = whole.select("doc_id", F.explode("wanted").alias("line"), "s").filter(F.get("s", F.col("line")).isNotNull())
    found = store(rows.select(F.struct("doc_id", "line").alias("p"), F.array_distinct(_split(F.get("s", F.col("line")))).alias("w")))
    discard(df.sparkSession, path)
    return found


def _verified(words: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the later lines of pairs that are similar by their words."""
    met = pairs.join(words.select(F.col("p").alias("a"), F.col("w").alias("x")), "a").join(words.select(F.col("p").alias("b"), F.col("w").alias("y")), "b")
    i = F.size(F.array_intersect("x", "y"))
    return met.filter(i * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("b.doc_id", "b.line").distinct()


def _in_waves(words: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the b of pairs (a, b, common) that match an a: each b first meets the a of most common tokens, and only if that fails its others."""
    best = pairs.groupBy("b").agg(F.max_by("a", "common").alias("a")).select("a", "b")
    first = cut(_verified(words, best, percent))
    still = pairs.join(first.select(F.struct("doc_id", "line").alias("b")), "b", "left_anti").select("a", "b")
    return first.union(_verified(words, still, percent))


@contextmanager
def _bloom(spark: SparkSession) -> Iterator[None]:
    """Lets the planner make Bloom filters of join keys for inputs of any size."""
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def later_matches(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, removed): the sorted numbers of each document's lines that an earlier line matches. Ids must not repeat."""
    spark = df.sparkSession
    with tidy(spark):
        hashed, hashed_path = store(hashes(df.filter(F.col(doc_id).isNotNull()), text, doc_id))
        every, every_path = store(lines(hashed, percent))
        discard(spark, hashed_path)
        first = F.min(F.struct("doc_id", "line", "n", "prefix", "p1", "p2")).alias("first")
        every = every.filter("n > 0")
        classes, class_path = store(every.groupBy("k", "n", "p1", "p2").agg(first).select("first.*"))
        places = cut(every.select("doc_id", "line"))
        discard(spark, every_path)
        with _bloom(spark):
            near = _to_earliest(classes, percent)
            words, word_path = _words_of(df, text, doc_id, near)
        # as a table, so that few of them are broadcast
        settled, settled_path = store(_in_waves(words, near, percent))
        discard(spark, word_path)
        flags = settled.select("doc_id", "line", F.lit(True).alias("settled"))
        flagged = classes.join(flags, ["doc_id", "line"], "left").select("doc_id", "line", "n", "p1", "p2", "prefix", F.col("settled").isNull().alias("open"))
        firsts = cut(classes.select("doc_id", "line"))
        # tokens are taken in parts, so that the shuffle files of one part are gone before the next
        parts = [store(_candidates(flagged, percent, i)) for i in range(PARTS)]
        discard(spark, class_path)
        every_pair = parts[0][0]
        for x, _ in parts[1:]:
            every_pair = every_pair.union(x)
        pairs, pair_path = store(every_pair.groupBy("a", "b").agg(F.sum("common").alias("common")))
        with _bloom(spark):
            words, word_path = _words_of(df, text, doc_id, pairs)
        late = cut(settled.union(_in_waves(words, pairs, percent)))
        for path in (word_path, pair_path, settled_path, *(x for _, x in parts)):
            discard(spark, path)
    gone = places.join(firsts, ["doc_id", "line"], "left_anti").union(late)
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def drop_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """df with the removed lines cut out of its texts; all rows and columns stay."""
    rows, key = by_row(df, text, doc_id)
    doc, removed = fresh("__doc", rows), fresh("__removed", rows)
    gone = later_matches(rows, text, key, percent).select(F.col("doc_id").alias(doc), F.col("removed").alias(removed))
    joined = rows.join(gone, F.col(key) == F.col(doc), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
    return joined.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept)).select(*df.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = by_row(table(spark, sf_dir, "documents"), "text", "doc_id")
    gone = cut(later_matches(docs, doc_id=key)).withColumnRenamed("doc_id", "__doc")
    whole = F.coalesce("text", F.lit(""))
    counted = docs.select(F.col(key).alias("__key"), "doc_id", (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    out = counted.join(gone, F.col("__key") == F.col("__doc"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


#: ``removed``: (doc_id, line) of later matches, as CTEs over (documents).
ORACLE_CTES = r"""
s AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS t, unnest(range(len(s))) AS line FROM s),
w AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT w, len(w) AS n, min(struct_pack(d := doc_id, l := line)) AS f FROM w WHERE len(w) > 0 GROUP BY w),
e AS (SELECT f, n, w, unnest(w) AS k FROM c),
d AS (SELECT k, count(*) AS df FROM e GROUP BY k),
o AS (SELECT f, n, w, k, row_number() OVER (PARTITION BY f ORDER BY df, k) AS pos FROM e JOIN d USING (k)),
p AS (SELECT * FROM o WHERE pos <= n - ceil(n * 0.8 - 1e-9) + 1),
j AS (SELECT DISTINCT a.f AS a, b.f AS b, a.w AS x, b.w AS y FROM p a JOIN p b ON a.k = b.k AND a.f < b.f AND a.n * 10 >= b.n * 8 AND b.n * 10 >= a.n * 8),
v AS (SELECT a, b FROM j WHERE len(list_intersect(x, y)) * 18 >= (len(x) + len(y)) * 8),
m AS (SELECT b AS f, min(a) AS a FROM v GROUP BY b),
removed AS (SELECT w.doc_id, w.line FROM w JOIN c ON w.w = c.w LEFT JOIN m ON m.f = c.f WHERE struct_pack(d := w.doc_id, l := w.line) > coalesce(m.a, c.f))
"""
ORACLE = f"""WITH {ORACLE_CTES},
g AS (SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS x FROM removed GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(g.x, '') AS removed_lines FROM s LEFT JOIN g USING (doc_id)"""
