"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text.

DataFrame functions only. A document is one row from scan to result: no shuffle, no state beyond the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, table

#: Phrases of boilerplate lines, looked for in the lower-cased line. Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "uses cookies",
    "privacy policy",
    "terms of service",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "share on facebook",
    "powered by wordpress",
)
#: Characters that separate the entries of a menu or the cells of a row.
SEPARATORS = "[|»›•·]"
SYMBOLS = "[#*$%&|<>]"
#: What a sentence ends with, closing quotes and brackets aside.
SENTENCE_END = "[.!?…:;。！？।؟][\"'”’»)\\]]*$"
#: Share of a document's letters and other non-space characters that its failing lines may hold.
MAX_LOST = 0.3


def _count(text: Column, pattern: str) -> Column:
    """How many characters match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _two(text: Column, marks: str) -> Column:
    """Whether two characters of a class stand in the text: most lines have none, and need no count."""
    return text.rlike(f"{marks}[^{marks[1:-1]}]*{marks}")


def line_fails(line: Column) -> Column:
    """The rules a line can fail; a blank line fails none.

    * boilerplate: it holds one of the phrases;
    * navigation: two separators or more, one for each four words at least;
    * symbols: two or more, one for each two words at least;
    * shouting: two ``!!`` or more, and no lower-case ASCII letter;
    * punctuation: ten words and more that hold no closing mark and don't end as a sentence does.
    """
    words = F.size(F.array_remove(F.split(line, f"{SPACE}+"), ""))

    def phrases(low: Column) -> Column:
        found = F.contains(low, F.lit(BOILERPLATE[0]))
        for p in BOILERPLATE[1:]:
            found = found | F.contains(low, F.lit(p))
        return found

    return F.coalesce(
        (line.rlike("!![^!]+!!") & ~line.rlike("[a-z]"))
        | (~line.rlike("[.!?…。！？।؟]") & ~F.rtrim(line).rlike(SENTENCE_END) & (words >= 10))
        | let(F.lower(line), phrases)
        | (_two(line, SEPARATORS) & (_count(line, SEPARATORS) * 4 >= words))
        | (_two(line, SYMBOLS) & (_count(line, SYMBOLS) * 2 >= words)),
        F.lit(False),
    )


def _repeat_words(words: Column) -> Column:
    """Words in five-word windows that the text has twice or more, each word once.

    Windows are told apart by a 64-bit hash. Most texts repeat none: a hash set tells, and only the others
    sort their (hash, place) pairs and add up the stretches that the repeated windows cover.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(pairs, places),
            zero,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    each = F.transform(words, lambda w: F.xxhash64(w))
    hashes = let(each, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(F.slice(h, i, 5))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(found)


def quality(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` plus ``cleaned`` (the text without failing lines), ``kept`` and the counts behind it.

    A null text has no words and fails (n_words < 10); an empty one likewise. Texts of any length stay whole.
    Repeated rows are judged alike, each by itself; a text at exactly ``max_lost`` stays; an empty table gives no rows. Other columns pass through; those named as a result are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_t", t)
    out = out.withColumn("_w", F.array_remove(F.split("_t", f"{SPACE}+"), ""))
    out = out.withColumn("_l", F.split("_t", "\n"))
    full = F.filter("_l", lambda x: x.rlike(NOT_SPACE))
    lines = let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long"),
            "_lines": lines,
            "n_repeat_words": let(F.col("_w"), _repeat_words),
            "cleaned": F.array_join(F.filter("_l", lambda x: ~line_fails(x)), "\n"),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": F.col("_lines.dup").cast("long"),
            "kept_chars": F.length(F.array_join(F.split("cleaned", f"{SPACE}+"), "")).cast("long"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    share = F.col("word_chars") - F.col("kept_chars") > max_lost * F.col("word_chars")
    return out.withColumn("kept", ~F.col("base_failed") & ~share).drop("_t", "_w", "_l", "_lines")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"
    )


def _sql(max_lost: float = MAX_LOST) -> str:
    def count(pattern: str) -> str:
        return f"(length(l) - length(regexp_replace(l, '{pattern}', '', 'g')))"

    end = SENTENCE_END.replace("'", "''")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') as w, string_split(t, chr(10)) as ls from d),
grams as (
  select doc_id, i, w[i:i+4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
again as (select doc_id, g from grams group by all having count(*) > 1),
cover as (
  select doc_id, count(distinct p) as n from (
    select doc_id, unnest(range(i, i + 5)) as p from grams join again using (doc_id, g)) group by doc_id),
lines as (
  select doc_id, k, l, {count(SEPARATORS)} as seps, {count(SYMBOLS)} as syms,
         len(list_filter(regexp_split_to_array(l, '{SPACE}+'), lambda x: x <> '')) as n
  from (select doc_id, unnest(ls) as l, unnest(range(len(ls))) as k from w)),
good as (
  select doc_id, sum(length(regexp_replace(l, '{SPACE}+', '', 'g'))) as c from lines
  where not (regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')
    or (seps >= 2 and seps * 4 >= n) or (syms >= 2 and syms * 2 >= n)
    or (regexp_matches(l, '!![^!]+!!') and not regexp_matches(l, '[a-z]'))
    or (n >= 10 and not regexp_matches(rtrim(l, ' '), '{end}') and not regexp_matches(l, '[.!?…。！？।؟]')))
  group by doc_id),
dup as (
  select doc_id, count(*) - count(distinct l) as n from lines where regexp_matches(l, '{NOT_SPACE}') group by doc_id),
base as (
  select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words,
         coalesce(good.c, 0)::bigint as kept_chars
  from w left join dup using (doc_id) left join cover using (doc_id) left join good using (doc_id)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from base)
select *, (not base_failed and not (word_chars - kept_chars > {max_lost} * word_chars)) as kept from f
"""


ORACLE = _sql()
