"""Benchmark decontamination by templates: numbers, names and units give way to typed placeholders.

DataFrame functions only. Windows of canonical tokens are hashed and joined with those of the benchmark; names in a row
are one slot, and so are numbers. Hits on one item that lie on neighbouring diagonals (offset between document and item)
form a band. A window of a band counts if its tokens are the item's as they stand, or if its slots agree with what the
band's slots mostly stand for, one to one. So a question asked again with other numbers or names is still found, with a
word put in or one name changed as well, and two texts that merely share a pattern are not. Windows of mostly slots say
little by their template; they count only where the tokens are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, sieved, table, written

#: Words in a window, and how many of them must be plain words for its template to count.
WINDOW, LITERALS = 8, 4
#: A document is contaminated if one band covers this share of an item's tokens, or so many of them.
MIN_SHARE, MIN_TOKENS = 0.5, 24
#: Diagonals of a band; each diagonal is in two, half a band apart.
BAND = 32
#: Windows of the benchmark up to which its side of the join is broadcast; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000
GAP = r"[^\p{L}\p{M}0-9%$€£]+"  # what may stand between the names, or numbers, of one slot
NAME = r"\p{Lu}[\p{L}\p{M}]*\p{Ll}[\p{L}\p{M}]*"
NUMBER = "[0-9]+(?:[.,][0-9]+)*+"
NAMES, NUMBERS = f"{NAME}(?:{GAP}{NAME})*+", f"{NUMBER}(?:{GAP}{NUMBER})*+"
TOKEN = rf"{NAMES}|[\p{{L}}\p{{M}}]+|{NUMBERS}|[%$€£]"
#: Unit names that stand for a unit right after a number. Fixed values.
UNITS = ("mm", "cm", "km", "kg", "mg", "lb", "oz", "ml", "mph", "kmh", "metres", "meters", "kilometres", "kilometers", "miles", "feet", "inches", "grams", "kilograms", "pounds", "ounces", "litres", "liters", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent")
MARKS = "#@%"  # placeholders of numbers, names and units


def tokens(text: Column) -> Column:
    """The text's words, runs of names, runs of numbers and currency signs as they stand."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def canonical(text: Column) -> Column:
    """As many tokens, lower-cased, with placeholders: ``#`` numbers, ``@`` names (capital first, a small letter
    later), ``%`` a unit: a currency or per cent sign, or a unit name that follows a number."""
    plain = F.regexp_replace(text, r"[#@]", " ")
    typed = F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{M}}]){NAMES}", "@")
    typed = F.regexp_replace(F.lower(typed), "[$€£]", "%")
    typed = F.regexp_replace(typed, rf"(?<=[0-9])([^\p{{L}}\p{{M}}0-9@%]*)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", "$1%")
    numbers = rf"{NUMBER}(?:[^\p{{L}}\p{{M}}0-9@%]+{NUMBER})*+"
    return F.regexp_extract_all(F.regexp_replace(typed, numbers, "#"), F.lit(r"[\p{L}\p{M}]+|[#@%]"), F.lit(0))


def _windows(canon: Column, n: int) -> Column:
    """Hash of each window of n tokens, by place."""
    each = F.transform(canon, lambda c: F.xxhash64(c))
    hashed = let(each, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n))))
    return F.when(F.size(canon) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def _benchmark(items: DataFrame, n: int) -> DataFrame:
    """A row for each window of each item: its length n, hash h, item_id, place, raw and canonical tokens, the item's size; ``k``, the
    hash of the raw tokens where they must be the same, else 0."""
    b = items.select("item_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    b = b.select("item_id", tokens(F.col("t")).alias("raw"), canonical(F.col("t")).alias("canon")).where(F.size("raw") > 0)
    b = b.withColumn("n", F.least(F.size("raw"), F.lit(n)))
    b = b.select("item_id", "n", "raw", "canon", F.size("raw").alias("size"), F.posexplode(F.sequence(F.lit(1), F.size("raw") - F.col("n") + 1)).alias("ipos", "at"))
    b = b.select("item_id", "n", "size", "ipos", F.slice("raw", F.col("at"), F.col("n")).alias("iraw"), F.slice("canon", F.col("at"), F.col("n")).alias("icanon"))
    plain = F.size(F.filter("icanon", lambda x: ~x.isin(*MARKS)))
    same = plain < F.least(F.lit(LITERALS), F.col("n"))
    return b.withColumns({"h": F.xxhash64(F.transform("icanon", lambda c: F.xxhash64(c))), "k": F.when(same, F.xxhash64("iraw")).otherwise(F.lit(0).cast("long"))})


def _hits(docs: DataFrame, bench: DataFrame, text: str, broadcast_windows: int) -> DataFrame:
    """Of docs (doc_id, th, text): doc_id, th, hits (array of n, h, dpos): windows whose template some item has."""
    known = bench.groupBy("n", "h").agg(F.max(F.col("k") != 0).alias("same"))
    counts = {r["n"]: r["count"] for r in known.groupBy("n").count().collect()}  # at most WINDOW rows
    d = docs.select("doc_id", "th", canonical(F.coalesce(text, F.lit(""))).alias("canon"))
    found = None
    for n, count in sorted(counts.items()) or [(WINDOW, 0)]:
        side = known.where(F.col("n") == n)
        rows = d.select("doc_id", "th", F.posexplode(_windows(F.col("canon"), n)).alias("dpos", "h"))
        hit = rows.join(F.broadcast(side) if count <= broadcast_windows else side, "h")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("n", "h", "same", "dpos")).alias("hits"))


def matches(docs: DataFrame, items: DataFrame, n: int = WINDOW, text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Bands with windows that count: doc_id, th (hash of the text), item_id, size (the item's tokens), covered (those in the band).

    Documents go by id and text, so a null or repeated id goes by itself. Items of fewer than n tokens are matched as one
    window of their own length; those without tokens, null texts among them, match nothing. Repeated rows of either side
    count once. Whole texts are read, of any length; empty tables match nothing. The same on either side of ``broadcast_windows``.
    """
    bench = written(_benchmark(items, n), "benchmark")
    docs = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = written(_hits(docs, bench, "text", broadcast_windows), "hits")
    there = sieved(docs, "th", found).withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    rows = found.join(there, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).dropDuplicates(["doc_id", "th"])
    rows = rows.select("doc_id", "th", tokens(F.col("text")).alias("raw"), F.explode("hits").alias("w"))
    rows = rows.select("doc_id", "th", "w.*", F.slice("raw", F.col("w.dpos") + 1, F.col("w.n")).alias("draw"))
    rows = rows.withColumn("k", F.when(F.col("same"), F.xxhash64("draw")).otherwise(F.lit(0).cast("long"))).drop("same")
    rows = rows.join(F.broadcast(bench) if bench.count() <= broadcast_windows else bench, ["n", "h", "k"])
    # the hash's word is not taken for it: canonical tokens of the document's window are compared as well
    equal = F.forall(F.zip_with("icanon", "draw", lambda c, b: F.struct(c.alias("c"), b.alias("b"))), lambda x: x["c"].isin(*MARKS) | (x["c"] == F.lower(x["b"])))
    sides = F.zip_with(F.zip_with("iraw", "icanon", lambda a, c: F.struct(c.alias("kind"), a.alias("a"))), "draw", lambda x, b: F.struct(x["kind"].alias("kind"), x["a"].alias("a"), b.alias("b")))
    slots = F.filter(sides, lambda x: x["kind"].isin(*MARKS))
    diag = F.col("dpos") - F.col("ipos")
    bands = F.array(2 * F.floor(diag / BAND), 2 * F.floor((diag + BAND // 2) / BAND) + 1)
    rows = rows.where(equal).select("doc_id", "th", "item_id", "size", "n", "ipos", "dpos", slots.alias("slots"), F.explode(bands).alias("band"))
    rows = rows.withColumn("verbatim", F.forall("slots", lambda x: x["a"] == x["b"]))
    group = ["doc_id", "th", "item_id", "size", "band"]
    each = rows.select(*group, "n", "ipos", "dpos", "verbatim", F.explode_outer("slots").alias("s")).select(*group, "n", "ipos", "dpos", "verbatim", "s.*")
    each = each.withColumn("c", F.count("*").over(Window.partitionBy(*group, "kind", "a", "b")))
    first = lambda of, by: F.rank().over(Window.partitionBy(*group, "kind", of).orderBy(F.desc("c"), F.desc(by))) == 1
    each = each.withColumn("steady", first("a", "b") & first("b", "a"))
    good = each.groupBy(*group, "n", "ipos", "dpos", "verbatim").agg(F.min("steady").alias("steady")).where("verbatim or steady")
    at = F.collect_set(F.struct("ipos", "n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda w: F.sequence(w["ipos"], w["ipos"] + w["n"] - 1)))))
    return good.groupBy(*group).agg(covered.alias("covered")).drop("band")


def contaminated(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS, **how) -> DataFrame:
    """Documents that hold an item: doc_id, th (hash of the text), items (array of item_id, sorted), covered (most tokens of one band)."""
    m = matches(docs, items, **how)
    m = m.where((F.col("covered") >= min_share * F.col("size")) | (F.col("covered") >= min_tokens))
    return m.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("covered").cast("long").alias("covered"))


def flagged(docs: DataFrame, found: DataFrame, text: str, how: str) -> DataFrame:
    """docs joined with what ``contaminated`` found; their own columns keep their names, the others start with ``_``."""
    found = found.withColumnsRenamed({c: f"_{c}" for c in found.columns})
    keyed = docs.withColumn("_key", F.xxhash64(text))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_th")), how)


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows are told apart by id and text: one of a null or repeated id goes by itself."""
    found = written(contaminated(docs.select("doc_id", F.col(text).alias("text")), items, **how), "contaminated")
    rows = docs.withColumn("_at", F.xxhash64(text))
    bad = found.withColumnRenamed("th", "_at")
    # most texts stay where they are: only those whose hash the sieve knows are held against what was found
    kept = flagged(sieved(rows, "_at", bad), found, text, "left_anti").select(*docs.columns)
    return kept.unionByName(sieved(rows, "_at", bad, "left_anti").select(*docs.columns))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    rows = flagged(docs, found, "text", "left").select("doc_id", "_items", "_covered")
    return rows.select(
        "doc_id",
        F.col("_items").isNotNull().alias("contaminated"),
        F.coalesce(F.array_join("_items", ","), F.lit("")).alias("item_ids"),
        F.coalesce("_covered", F.lit(0).cast("long")).alias("covered"),
    )


def _sql() -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    pattern = TOKEN.replace("*+", "*")

    def side(table: str, key: str, id_: str) -> str:
        return f"""
{key}t as (select {id_}, t, unnest(t) as w, unnest(range(len(t))) as p from
  (select {id_}, regexp_extract_all(coalesce(text, ''), '{pattern}') as t from {table})),
{key}c as (select {id_}, p, w, case
    when regexp_matches(w, '^[0-9]') then '#'
    when regexp_matches(w, '^{NAME}') then '@'
    when w in ('$', '€', '£', '%') or (lower(w) in ({units}) and regexp_matches(lag(w) over o, '^[0-9]')) then '%'
    else lower(w) end as c, len(t) as size
  from {key}t window o as (partition by {id_} order by p)),
{key}w as (select {id_}, size, p, list(c) over o as c, list(w) over o as w from {key}c
  window o as (partition by {id_} order by p rows between current row and {WINDOW - 1} following))"""

    grp = "doc_id, item_id, size, band"
    return f"""
with {side("documents", "d", "doc_id")}, {side("(select distinct * from benchmark)", "b", "item_id")},
b as (select *, len(c) as n, len(list_filter(c, lambda x: x not in ('#', '@', '%'))) < least({LITERALS}, len(c)) as same
  from bw where len(c) = least({WINDOW}, size)),
hit as (select d.doc_id, b.item_id, b.size, b.n, b.p as ipos, d.p as dpos, b.c as c, b.w as a, d.w[1:b.n] as b, b.same
  from dw d join b on d.c[1:{WINDOW}] = b.c where b.n = {WINDOW}
  union all
  select d.doc_id, b.item_id, b.size, b.n, b.p, d.p, b.c, b.w, d.w[1:b.n], b.same
  from dw d join b on d.c[1:b.n] = b.c where b.n < {WINDOW}),
hits as (select *, a = b as verbatim, unnest([2 * floor((dpos - ipos) / {BAND}.0), 2 * floor((dpos - ipos + {BAND // 2}) / {BAND}.0) + 1]) as band
  from hit where not same or a = b),
slot as (select *, count(*) over (partition by {grp}, kind, x, y) as k from
  (select {grp}, n, ipos, dpos, verbatim, unnest(c) as kind, unnest(a) as x, unnest(b) as y from hits) where kind in ('#', '@', '%')),
steady as (select *, rank() over (partition by {grp}, kind, x order by k desc, y desc) = 1
  and rank() over (partition by {grp}, kind, y order by k desc, x desc) = 1 as ok from slot),
bad as (select distinct {grp}, n, ipos, dpos from steady where not ok and not verbatim),
cover as (select {grp}, count(distinct k) as covered from
  (select *, unnest(range(ipos, ipos + n)) as k from hits) anti join bad using ({grp}, n, ipos, dpos) group by all),
f as (select doc_id, array_to_string(list_sort(list(distinct item_id)), ',') as items, max(covered) as covered from
  (select doc_id, item_id, max(covered) as covered from cover
   where covered >= {MIN_SHARE} * size or covered >= {MIN_TOKENS} group by all) group by doc_id)
select d.doc_id, f.items is not null as contaminated, coalesce(f.items, '') as item_ids, coalesce(f.covered, 0)::bigint as covered
from documents d left join f using (doc_id)
"""


ORACLE = _sql()
