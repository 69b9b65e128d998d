"""Quality rules: a table of thresholds compiled into one projection of SQL expressions.

Words are `[^\\x20\\x09-\\x0D]+`.  A rule bounds the ratio of two counts of a text; the table is
compiled to one boolean expression over the counts, evaluated by Spark alone.

Null texts count as empty: no words, hence rejected.  Rows are independent, so repeated rows
and ties each get their own verdict.  Other columns pass through; in `measured` and `judged` a count or
verdict replaces a column of its name, in `accepted` all columns stay as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WS = r"[\\x20\\x09-\\x0D]"
NOT_WS = r"[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"

# The commonest words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this at are an from "
    "de la le les des un une et est en du que qui pour dans par sur au "
    "el los las y del se su con al lo como "
    "der die das und den von zu mit sich auf ist im nicht ein eine als auch es"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= 100 * count / of <= high, with either bound left out if None. A ratio to nothing passes."""

    name: str
    count: str
    of: str
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        bounds = [f"100 * {self.count} >= {self.low} * {self.of}"] * (self.low is not None) + [f"100 * {self.count} <= {self.high} * {self.of}"] * (self.high is not None)
        return "(" + " AND ".join(bounds) + ")"


#: Base rules decide base_failed; the others are the method's own verdict. Percent.
BASE = (Rule("length", "n_words", "1", low=5_000), Rule("repeated windows", "n_repeat_words", "n_words", high=50))
RULES = (
    Rule("symbols a word", "n_symbols", "n_words", high=25),
    Rule("shouted words", "n_shouted", "n_words", high=25),
    Rule("stop words", "n_stop_words", "n_words", low=2),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
    Rule("letters a word", "word_chars", "n_words", low=200, high=2_000),
)


def compiled(rules: tuple[Rule, ...]) -> str:
    return " AND ".join(r.sql() for r in rules) or "true"


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that rules are about."""
    own = ["n_words", "word_chars", "n_symbols", "n_shouted", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = [f"`{c}`" for c in df.columns if c not in own and c != text]
    kept = [*rest, f"`{text}`"]
    tmp = "__lw_"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    a = df.selectExpr(*kept, f"coalesce(`{text}`, '') AS {tmp}t")
    b = a.selectExpr(
        *kept, f"{tmp}t",
        f"array_remove(split({tmp}t, '{WS}+'), '') AS {tmp}w",
        f"filter(split({tmp}t, '\\n'), l -> l rlike '{NOT_WS}') AS {tmp}l",
    )
    c = b.selectExpr(
        *kept, f"{tmp}t", f"{tmp}w", f"{tmp}l",
        f"if(size({tmp}w) < 3, cast(array() as array<bigint>), slice(transform({tmp}w, (x, i) -> xxhash64(x, get({tmp}w, i + 1), get({tmp}w, i + 2))), 1, greatest(size({tmp}w) - 2, 1))) AS {tmp}h",
    )
    d = c.selectExpr(
        *kept,
        f"cast(size({tmp}w) as bigint) AS n_words",
        f"cast(char_length(array_join({tmp}w, '')) as bigint) AS word_chars",
        f"cast(char_length({tmp}t) - char_length(regexp_replace({tmp}t, '{SYMBOLS}', '')) as bigint) AS n_symbols",
        f"cast(if(contains({tmp}t, '!!'), size(filter({tmp}w, x -> endswith(rtrim('.,', x), '!!'))), 0) as bigint) AS n_shouted",
        f"cast(size(filter({tmp}w, x -> lower(x) in ({stop}))) as bigint) AS n_stop_words",
        f"cast(size({tmp}l) as bigint) AS n_lines",
        f"cast(size({tmp}l) - size(array_distinct({tmp}l)) as bigint) AS n_dup_lines",
        # only a text in which a window recurs is sorted
        f"if(size(array_distinct({tmp}h)) = size({tmp}h), null, sort_array(transform({tmp}h, (x, i) -> struct(x AS h, i AS i)))) AS {tmp}s",
    )
    e = d.selectExpr(
        *kept, *[c for c in own if c != "n_repeat_words"],
        f"sort_array(filter(transform({tmp}s, (x, i) -> if(x.h = get({tmp}s, i - 1).h or x.h = get({tmp}s, i + 1).h, x.i, -1)), p -> p >= 0)) AS {tmp}p",
    )
    return e.selectExpr(
        *kept, *[c for c in own if c != "n_repeat_words"],
        f"cast(coalesce(aggregate(transform({tmp}p, (p, i) -> least(3, coalesce(get({tmp}p, i + 1) - p, 3))), 0, (a, x) -> a + x), 0) as bigint) AS n_repeat_words",
    )


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the counts, base_failed and kept."""
    return measured(df, text).withColumn("base_failed", F.expr(f"NOT ({compiled(BASE)})")).withColumn("kept", F.expr(f"NOT base_failed AND {compiled(rules)}"))


def accepted(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, all columns as they are. Rows are picked by a generator: a filter would be moved below the counts and repeat their expressions many times over."""
    own = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), df[text].alias("text"))
    return judged(own).withColumn("__one", F.expr("explode(if(kept, array(1), cast(array() as array<int>)))")).select("__row.*")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouted", "n_stop_words", "n_lines"]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
COUNTS_SQL = f"""
SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
       CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(list_filter(w, lambda x: suffix(rtrim(x, '.,'), '!!'))) AS BIGINT) AS n_shouted,
       CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
       CAST(len(l) AS BIGINT) AS n_lines,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words
FROM (SELECT doc_id, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
      FROM documents)
LEFT JOIN (
  SELECT doc_id, count(DISTINCT p) AS covered FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)))
    WHERE n > 1)
  GROUP BY doc_id) USING (doc_id)
"""
JUDGED_SQL = f"SELECT *, NOT base_failed AND {compiled(RULES)} AS kept FROM (SELECT *, NOT ({compiled(BASE)}) AS base_failed FROM ({COUNTS_SQL}))"
ORACLE_SQL = f"SELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM ({JUDGED_SQL})"
