"""The queries of the arithmetic core, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc, corpus, lanes, locate, vectors
from ..operators import batches, heads, joined_calc, problems, reports, spans
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY = ["l_orderkey", "l_linenumber"]
DMAX = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def lineitem(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "lineitem").select(*KEY, "l_partkey", *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, "documents").select("doc_id", "text")


# --- the calculator ------------------------------------------------------------------


def _calculated(rows: DataFrame, a: str, b: str, op: str, dmax: int = DMAX, native: bool = False) -> DataFrame:
    own = calc.calculate_native(F.col(a), F.col(b), op, dmax) if native else calc.calculate(F.col(a), F.col(b), op, dmax, digits=False)
    return rows.withColumn("c", own).select(*KEY, "c.result", "c.refused", "c.reason")


_WIDE = "CAST(l_{0} AS DECIMAL(38,0))"
_ADD = "SELECT l_orderkey, l_linenumber, CAST(l_orderkey + l_partkey AS VARCHAR) AS result, false AS refused, CAST(NULL AS VARCHAR) AS reason FROM lineitem"
_SUB = "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey >= l_orderkey THEN CAST(l_partkey - l_orderkey AS VARCHAR) END AS result, l_partkey < l_orderkey AS refused, CASE WHEN l_partkey < l_orderkey THEN 'negative' END AS reason FROM lineitem"
_MUL = "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_partkey AS VARCHAR) AS result, false AS refused, CAST(NULL AS VARCHAR) AS reason FROM lineitem"


@query(_ADD)
def calc_add(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "add")


@query(_SUB)
def calc_sub_refused(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_partkey", "l_orderkey", "sub")


@query(_MUL)
def calc_mul(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "mul")


@query(_ADD)
def exact_add(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "add", native=True)


@query(_SUB)
def exact_sub_refused(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_partkey", "l_orderkey", "sub", native=True)


@query(_MUL)
def exact_mul(spark, sf_dir):
    return _calculated(lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "mul", native=True)


def _wide(name: str) -> F.Column:
    """A 16-digit number from a line's keys."""
    return corpus.sample_width(F.lit(16), F.concat_ws(":", F.lit(name), *KEY))


def _wide_sql(name: str) -> str:
    return f"(1000000000000000 + (('0x' || md5(concat_ws(':', '{name}', l_orderkey, l_linenumber))[1:15])::BIGINT) % 9000000000000000)"


@query(f"SELECT l_orderkey, l_linenumber, CAST(CAST({_wide_sql('a')} AS HUGEINT) * {_wide_sql('b')} AS VARCHAR) AS result, false AS refused, CAST(NULL AS VARCHAR) AS reason FROM lineitem")
def calc_wide_mul(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("a", _wide("a")).withColumn("b", _wide("b"))
    return _calculated(rows, "a", "b", "mul")


PAIR = ["l_orderkey", "l_partkey"]


def _pairs(spark, sf_dir):
    """Distinct pairs of operands."""
    return lineitem(spark, sf_dir).select(*PAIR).distinct().withColumn("a", F.col("l_orderkey")).withColumn("b", F.col("l_partkey"))


@query("SELECT DISTINCT l_orderkey, l_partkey, CAST(l_orderkey * l_partkey AS VARCHAR) AS result FROM lineitem")
def calc_mul_join(spark, sf_dir):
    return joined_calc.multiplied(_pairs(spark, sf_dir), PAIR, "a", "b")


@query("""
SELECT DISTINCT l_orderkey, l_partkey, CAST(place AS INTEGER) AS place,
       CAST((CAST(l_orderkey AS HUGEINT) + l_partkey) // CAST(power(10, place) AS HUGEINT) % 10 AS INTEGER) AS digit
FROM lineitem, range(8) AS r(place)""")
def carry_window(spark, sf_dir):
    both = F.zip_with(lanes.digits_lsd(F.col("a"), 8), lanes.digits_lsd(F.col("b"), 8), lambda x, y: x + y)
    return joined_calc.carried(_pairs(spark, sf_dir).select(*PAIR, F.posexplode(both).alias("place", "sum")), PAIR)


@query("""
SELECT op, reason, count(*) AS n FROM (
  SELECT op, CASE WHEN l_orderkey > 9999 OR l_partkey > 9999 THEN 'operand too wide' WHEN op = 'sub' AND l_orderkey < l_partkey THEN 'negative' END AS reason
  FROM lineitem, (VALUES ('add'), ('sub'), ('mul')) AS o(op))
GROUP BY op, reason""")
def refusal_counts(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("op", F.explode(F.array(*map(F.lit, calc.OPS))))
    own = calc.by_operation(F.col("op"), {o: calc.calculate_native(F.col("l_orderkey"), F.col("l_partkey"), o, 4) for o in calc.OPS})
    return rows.withColumn("reason", own["reason"]).groupBy("op", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT digit, count(*) AS n FROM (
  SELECT unnest(list_transform(range(16), lambda k: CAST((l_orderkey * l_partkey) // CAST(power(10, k) AS BIGINT) % 10 AS BIGINT))) AS digit FROM lineitem)
GROUP BY digit""")
def digit_histogram(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select(F.explode(lanes.digits_lsd(F.col("l_orderkey") * F.col("l_partkey"), 16)).alias("digit"))
    return rows.groupBy("digit").agg(F.count("*").alias("n"))


# --- numbers in text -----------------------------------------------------------------

_RUNS_SQL = """
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS len, string_agg(ch, '' ORDER BY pos) AS run FROM (
  SELECT doc_id, pos, ch, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0)
  WHERE ch BETWEEN '0' AND '9' AND regexp_matches(ch, '[0-9]'))
GROUP BY doc_id, island"""


def _runs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.inline(locate.digit_runs(F.col("text"))))


@query(_RUNS_SQL)
def digit_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"SELECT doc_id, start, len FROM ({_RUNS_SQL})")
def run_islands(spark, sf_dir):
    return _runs(spark, sf_dir).select("doc_id", "start", "len")


@query("SELECT doc_id, coalesce(nullif(ltrim(run, '0'), ''), '0') AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS run FROM documents) GROUP BY ALL")
def run_values(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(locate.run_values(F.col("text"))).alias("run"))
    return rows.groupBy("doc_id", lanes.as_digits(F.col("run")).alias("value")).agg(F.count("*").alias("n"))


@query(f"""
SELECT doc_id, start, CASE WHEN length(v) <= 16 THEN array_to_string(list_transform(range(16), lambda k: CASE WHEN k < length(v) THEN v[length(v) - k] ELSE '0' END), ',') END AS digits, length(v) > 16 AS refused
FROM (SELECT *, coalesce(nullif(ltrim(run, '0'), ''), '0') AS v FROM ({_RUNS_SQL}))""")
def digits_lsd(spark, sf_dir):
    """Digits of every run; one wider than the lanes is a refused row."""
    rows = _runs(spark, sf_dir).withColumn("own", lanes.digits_lsd(F.col("run"), 16))
    return rows.select("doc_id", "start", F.array_join(F.col("own").cast("array<string>"), ",").alias("digits"), F.col("own").isNull().alias("refused"))


@query(f"""
SELECT doc_id, start, CASE WHEN len <= 16 THEN array_to_string(list_transform(range(16), lambda k: CAST(CASE WHEN k < len THEN start + len - 1 - k ELSE -1 END AS VARCHAR)), ',') END AS lanes, len > 16 AS refused
FROM ({_RUNS_SQL})""")
def lane_positions(spark, sf_dir):
    own = lanes.lanes_lsd(F.col("start"), F.col("len"), 16)
    return _runs(spark, sf_dir).withColumn("own", own).select("doc_id", "start", F.array_join(F.col("own").cast("array<string>"), ",").alias("lanes"), F.col("own").isNull().alias("refused"))


_CLASSES_SQL = """
SELECT doc_id, cls, min(pos) AS start, count(*) AS len FROM (
  SELECT doc_id, pos, cls, pos - row_number() OVER (PARTITION BY doc_id, cls ORDER BY pos) AS island FROM (
    SELECT doc_id, pos, CASE WHEN regexp_matches(ch, '[0-9]') THEN 1 WHEN regexp_matches(ch, '[A-Za-z]') THEN 2 ELSE 0 END AS cls FROM (
      SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0))
  WHERE cls > 0)
GROUP BY doc_id, cls, island"""


@query(f"""
SELECT doc_id, CAST(cls AS INTEGER) AS cls, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, cls ORDER BY len DESC, start) AS rank FROM ({_CLASSES_SQL})) WHERE rank = 1""")
def longest_span(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(c).alias("cls"), spans.longest_run(F.col("text"), p).alias("run")) for c, p in ((1, "[0-9]"), (2, "[A-Za-z]"))])
    return documents(spark, sf_dir).select("doc_id", F.inline(each)).where("run IS NOT NULL").select("doc_id", "cls", "run.start", "run.len")


@query("""
SELECT doc_id, CASE WHEN length(a) <= 16 AND length(b) <= 16 THEN CAST(CAST(a AS HUGEINT) + CAST(b AS HUGEINT) AS VARCHAR) END AS result,
       length(a) > 16 OR length(b) > 16 AS refused
FROM (SELECT doc_id, coalesce(nullif(ltrim(r[1], '0'), ''), '0') AS a, coalesce(nullif(ltrim(r[2], '0'), ''), '0') AS b
      FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS r FROM documents) WHERE len(r) >= 2)""")
def first_two_operands(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("r", locate.run_values(F.col("text"))).where(F.size("r") >= 2)
    rows = rows.withColumn("c", calc.calculate_native(F.get("r", F.lit(0)), F.get("r", F.lit(1)), "add"))
    return rows.select("doc_id", "c.result", "c.refused")


# --- splits and problems -------------------------------------------------------------

_OP_SQL = "['add', 'sub', 'mul'][l_linenumber % 3 + 1]"
_SPLIT_SQL = f"SELECT l_orderkey, l_linenumber, {_OP_SQL} AS op, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, (('0x' || md5(concat_ws(':', {_OP_SQL}, l_orderkey, l_partkey))[1:8])::BIGINT) % 100 AS h FROM lineitem)"


def _split(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, calc.OPS)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = lineitem(spark, sf_dir).withColumn("op", op)
    return rows.withColumn("split", corpus.split_of(F.col("op"), F.col("l_orderkey"), F.col("l_partkey")))


@query(_SPLIT_SQL)
def split_of(spark, sf_dir):
    return _split(spark, sf_dir).select(*KEY, "op", "split")


@query(f"SELECT op, split, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY op, split")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("op", "split").agg(F.count("*").alias("n"))


_PROBLEM_SPLIT_SQL = _SPLIT_SQL.replace("SELECT l_orderkey,", "SELECT l_partkey, l_orderkey,", 1)


@query(f"""
SELECT count(*) AS shared FROM (SELECT op, l_orderkey, l_partkey FROM ({_PROBLEM_SPLIT_SQL}) WHERE split = 'train'
  INTERSECT SELECT op, l_orderkey, l_partkey FROM ({_PROBLEM_SPLIT_SQL}) WHERE split = 'test')""")
def split_disjoint(spark, sf_dir):
    rows = _split(spark, sf_dir).select("op", "l_orderkey", "l_partkey", "split")
    both = rows.where("split = 'train'").drop("split").intersect(rows.where("split = 'test'").drop("split"))
    return both.agg(F.count("*").alias("shared"))


_TEMPLATES_SQL = "(VALUES " + ", ".join(f"('{op}', {i}, '{t}')" for op, own in corpus.TEMPLATES.items() for i, t in enumerate(own)) + ") AS t(op, tmpl, template)"
PER_CELL, N_OFF = 40, 100


def _sample_sql(width: str, key: str) -> str:
    return f"(CAST(rpad('1', {width}, '0') AS BIGINT) + (('0x' || md5({key})[1:15])::BIGINT) % (9 * CAST(rpad('1', {width}, '0') AS BIGINT)))"


def _distractor_sql(n: int, used: str) -> str:
    number = _sample_sql(f"CAST((('0x' || md5(key || ':w{n}:' || i)[1:15])::BIGINT) % 6 + 1 AS INTEGER)", f"key || ':d{n}:' || i")
    return f"list_filter(list_transform(range(6), lambda i: {number}), lambda d: NOT list_contains([{used}], CAST(d AS HUGEINT)))[1]"


_GRID_SQL = "(VALUES " + ", ".join(f"('{o}', '{c}', {i * len(corpus.TRAIN_CELLS) + j})" for i, o in enumerate(calc.OPS) for j, c in enumerate(corpus.TRAIN_CELLS)) + ") AS g(op, cell, place)"
_ARITH_SQL = f"""
WITH tries AS (
  SELECT op, cell, place, slot, key, try, {_sample_sql("CAST(string_split(cell, 'x')[1] AS INTEGER)", "key || ':' || try || ':a'")} AS x, {_sample_sql("CAST(string_split(cell, 'x')[2] AS INTEGER)", "key || ':' || try || ':b'")} AS y
  FROM (SELECT *, concat_ws(':', 'train', 0, op, cell, slot) AS key FROM {_GRID_SQL}, range({PER_CELL}) AS s(slot)), range(64) AS r(try)),
ordered AS (SELECT *, CASE WHEN op = 'sub' THEN greatest(x, y) ELSE x END AS a, CASE WHEN op = 'sub' THEN least(x, y) ELSE y END AS b FROM tries),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY op, cell, slot ORDER BY try) AS rank FROM ordered
  WHERE (('0x' || md5(concat_ws(':', op, a, b))[1:8])::BIGINT) % 100 < 80),
answered AS (
  SELECT *, CASE op WHEN 'add' THEN CAST(a AS HUGEINT) + b WHEN 'sub' THEN CAST(a AS HUGEINT) - b ELSE CAST(a AS HUGEINT) * b END AS ans,
         CAST((('0x' || md5(key || ':t')[1:15])::BIGINT) % 6 AS INTEGER) AS tmpl
  FROM chosen WHERE rank = 1),
first AS (SELECT *, {_distractor_sql(1, "CAST(a AS HUGEINT), CAST(b AS HUGEINT), ans")} AS d1 FROM answered)
SELECT place * {PER_CELL} + slot AS seq, f.op, CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(ans AS VARCHAR) AS ans,
       replace(replace(replace(template, '{{a}}', CAST(a AS VARCHAR)), '{{b}}', CAST(b AS VARCHAR)), '{{d1}}', CAST(d1 AS VARCHAR)) AS prompt,
       ' ' || CAST(ans AS VARCHAR) || chr(10) AS completion, cell, f.tmpl
FROM first f JOIN {_TEMPLATES_SQL} ON f.op = t.op AND f.tmpl = t.tmpl"""
_N_ARITH = PER_CELL * len(corpus.TRAIN_CELLS) * len(calc.OPS)


def _off_number_sql(n: int) -> str:
    return _sample_sql(f"CAST((('0x' || md5(key || ':w{n}')[1:15])::BIGINT) % 8 + 1 AS INTEGER)", f"key || ':d{n}'")


_OFF_SQL = f"""
SELECT id + {_N_ARITH} AS seq, 'off' AS op, '0' AS a, '0' AS b, '0' AS ans,
       replace(replace(template, '{{d1}}', CAST({_off_number_sql(1)} AS VARCHAR)), '{{d2}}', CAST({_off_number_sql(2)} AS VARCHAR)) AS prompt, '' AS completion, '' AS cell, o.tmpl
FROM (SELECT *, CAST((('0x' || md5(key || ':t')[1:15])::BIGINT) % 6 AS INTEGER) AS tmpl FROM (SELECT id, 'train:0:off:' || id AS key FROM range({N_OFF}) AS r(id))) o
JOIN {_TEMPLATES_SQL} ON t.op = 'off' AND o.tmpl = t.tmpl"""
_UNION_SQL = f"SELECT * FROM ({_ARITH_SQL}) UNION ALL SELECT * FROM ({_OFF_SQL})"


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "op", *[F.col(c).cast("string").alias(c) for c in ("a", "b", "ans")], "prompt", "completion", "cell", "tmpl")


def _problems(spark):
    return problems.generate(spark, "train", corpus.TRAIN_CELLS, per_cell=PER_CELL, n_off=N_OFF)


@query(_ARITH_SQL)
def corpus_arith(spark, sf_dir):
    return _texts(problems.arithmetic(spark, "train", corpus.TRAIN_CELLS, per_cell=PER_CELL))


@query(_OFF_SQL)
def corpus_off(spark, sf_dir):
    return _texts(problems.off_rows(spark, "train", N_OFF, first=_N_ARITH))


@query(_UNION_SQL)
def corpus_union(spark, sf_dir):
    return _texts(_problems(spark))


@query(f"""
SELECT count(*) AS n FROM (
  SELECT u.*, regexp_extract_all(prompt, '[0-9]+') AS v, regexp_extract_all(template, '\\{{(a|b|d1|d2)\\}}', 1) AS r FROM ({_UNION_SQL}) u JOIN {_TEMPLATES_SQL} ON u.op = t.op AND u.tmpl = t.tmpl)
WHERE len(v) <> len(r) OR (op <> 'off' AND (v[list_position(r, 'a')] <> a OR v[list_position(r, 'b')] <> b)) OR (op = 'sub' AND CAST(a AS HUGEINT) < CAST(b AS HUGEINT))""")
def corpus_violations(spark, sf_dir):
    return problems.violations(_problems(spark)).agg(F.count("*").alias("n"))


@query(f"SELECT op, tmpl, array_to_string(list_transform(regexp_extract_all(template, '\\{{(a|b|d1|d2)\\}}', 1), lambda x: x[1:1]), ',') AS roles FROM {_TEMPLATES_SQL}")
def roles_of(spark, sf_dir):
    return problems.template_table(spark).select("op", "tmpl", F.array_join("roles", ",").alias("roles"))


@query(f"SELECT op, tmpl, CAST(CASE op WHEN 'add' THEN 0 WHEN 'sub' THEN 1 WHEN 'mul' THEN 2 ELSE 3 END AS INTEGER) AS label FROM {_TEMPLATES_SQL}")
def op_label(spark, sf_dir):
    return problems.template_table(spark).select("op", "tmpl", corpus.op_label(F.col("op"), calc.OPS).alias("label"))


@query("SELECT cell, CAST(string_split(cell, 'x')[1] AS INTEGER) AS da, CAST(string_split(cell, 'x')[2] AS INTEGER) AS db FROM (VALUES " + ", ".join(f"('{c}')" for c in corpus.EVAL_CELLS) + ") AS c(cell)")
def cell_parse(spark, sf_dir):
    da, db = corpus.cell_widths(F.col("cell"))
    return spark.createDataFrame([(c,) for c in corpus.EVAL_CELLS], "cell string").select("cell", da.alias("da"), db.alias("db"))


_ORDER_SQL = f"SELECT seq, CAST(place // 32 AS BIGINT) AS batch FROM (SELECT seq, row_number() OVER (ORDER BY md5(concat_ws(':', 0, 1, seq)), seq) - 1 AS place, count(*) OVER () AS total FROM ({_UNION_SQL})) WHERE (place // 32 + 1) * 32 <= total"


@query(_ORDER_SQL)
def epoch_batches(spark, sf_dir):
    return problems.epoch(_problems(spark), 0, 1, 32).select("seq", "batch")


# --- batches -------------------------------------------------------------------------


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


def _list_sql(n: str, body: str) -> str:
    return f"array_to_string(list_transform(range({n}), lambda k: CAST({body} AS VARCHAR)), ',')"


@query(f"""
SELECT seq, {_list_sql("32", "CASE WHEN k < n THEN length(prompt) + n - 1 - k ELSE -1 END")} AS w_pos, {_list_sql("32", "CASE WHEN k < n THEN CAST(ans[n - k] AS INTEGER) ELSE -100 END")} AS w_tok
FROM (SELECT *, CASE WHEN op = 'off' THEN 0 ELSE length(ans) END AS n FROM ({_UNION_SQL}))""")
def answer_lanes(spark, sf_dir):
    return batches.build(_problems(spark)).select("seq", _joined("w_pos"), _joined("w_tok"))


# the operand's number among the prompt's numbers is its slot's among the template's
_PLACED_SQL = f"""
SELECT seq, u.op, prompt, a, b, list_position(r, 'a') AS a_slot, list_position(r, 'b') AS b_slot, regexp_split_to_array(prompt, '[0-9]+') AS gaps, regexp_extract_all(prompt, '[0-9]+') AS v
FROM (SELECT u.*, regexp_extract_all(template, '\\{{(a|b|d1|d2)\\}}', 1) AS r FROM ({_UNION_SQL}) u JOIN {_TEMPLATES_SQL} ON u.op = t.op AND u.tmpl = t.tmpl) u"""


def _at_sql(slot: str) -> str:
    return f"(list_sum(list_transform(gaps[1:{slot}], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:{slot} - 1], lambda x: length(x))), 0))"


@query(f"""
SELECT seq, {_list_sql("length(prompt)", "CASE WHEN op = 'off' THEN -100 WHEN k >= a_at AND k < a_at + length(a) THEN 1 WHEN k >= b_at AND k < b_at + length(b) THEN 2 ELSE 0 END")} AS span_labels
FROM (SELECT *, {_at_sql("a_slot")} AS a_at, {_at_sql("b_slot")} AS b_at FROM ({_PLACED_SQL}))""")
def span_labels(spark, sf_dir):
    return batches.build(_problems(spark)).select("seq", _joined("span_labels"))


@query(f"""
SELECT seq, {_list_sql("16", "CASE WHEN op <> 'off' AND k < length(a) THEN CAST(a[length(a) - k] AS INTEGER) ELSE -100 END")} AS a_dig, {_list_sql("16", "CASE WHEN op <> 'off' AND k < length(b) THEN CAST(b[length(b) - k] AS INTEGER) ELSE -100 END")} AS b_dig
FROM ({_UNION_SQL})""")
def digit_targets(spark, sf_dir):
    return batches.build(_problems(spark)).select("seq", _joined("a_dig"), _joined("b_dig"))


@query(f"""
SELECT seq, batch, n, width, {_list_sql("width", "CASE WHEN k < n THEN 1 ELSE 0 END")} AS mask
FROM (SELECT seq, batch, n, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS width FROM (
  SELECT o.seq, o.batch, CAST(length(prompt) + length(completion) AS INTEGER) AS n FROM ({_ORDER_SQL}) o JOIN ({_UNION_SQL}) u ON o.seq = u.seq))""")
def pad_mask(spark, sf_dir):
    rows = batches.build(_problems(spark)).withColumn("n", F.size("tokens"))
    order = problems.epoch(_problems(spark), 0, 1, 32).select("seq", "batch")
    return batches.padded_to_longest(rows.join(order, "seq")).select("seq", "batch", "n", "width", _joined("mask"))


# --- reports over recorded predictions ------------------------------------------------


def _mark_sql(name: str, rate: int) -> str:
    return f"(('0x' || md5(concat_ws(':', '{name}', l_orderkey, l_linenumber))[1:8])::BIGINT) % 100 < {rate}"


_RATES = {"host": 18, "span": 97, "calc": 96, "route": 99, "fired": 2}
_PREDICTIONS_SQL = f"""
SELECT *, span AND calc AND route AS block FROM (
  SELECT l_orderkey * 8 + l_linenumber AS seq, ['add', 'sub', 'mul', 'off'][l_linenumber % 4 + 1] AS op,
         CASE WHEN l_linenumber % 4 = 3 THEN '' ELSE length(CAST(l_orderkey AS VARCHAR)) || 'x' || length(CAST(l_partkey AS VARCHAR)) END AS cell,
         {", ".join(f"{_mark_sql(k, r)} AS {k}" for k, r in _RATES.items())}
  FROM lineitem)"""


def _predictions(spark, sf_dir):
    """Recorded predictions: lines as problems, errors by hash."""
    mark = lambda name, rate: corpus.hash_number(F.concat_ws(":", F.lit(name), *KEY), 8) % 100 < rate
    op = F.element_at(F.array(*map(F.lit, (*calc.OPS, "off"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    cell = F.concat_ws("x", F.length(F.col("l_orderkey").cast("string")), F.length(F.col("l_partkey").cast("string")))
    rows = lineitem(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), op.alias("op"), cell.alias("cell"), *[mark(k, r).alias(k) for k, r in _RATES.items()])
    return rows.withColumn("cell", F.when(F.col("op") == "off", "").otherwise(F.col("cell"))).withColumn("block", F.expr("span AND calc AND route"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _rates_sql(names: tuple[str, ...], n: str) -> str:
    return ", ".join(f"round(count(*) FILTER ({m}) / {n}, 9) AS {m}" for m in names)


@query(f"SELECT op, cell, count(*) AS n, {_rates_sql(('host', 'block', 'span', 'calc', 'route'), 'count(*)')} FROM ({_PREDICTIONS_SQL}) GROUP BY op, cell")
def accuracy_by_cell(spark, sf_dir):
    return _rounded(reports.by_cell(_predictions(spark, sf_dir)))


@query(f"""
SELECT count(*) FILTER (op <> 'off') AS n_arithmetic, count(*) FILTER (op = 'off') AS n_off,
       {", ".join(f"round(count(*) FILTER (op <> 'off' AND {m}) / count(*) FILTER (op <> 'off'), 9) AS {m}" for m in reports.MEASURES)},
       round(count(*) FILTER (route) / count(*), 9) AS route, round(count(*) FILTER (op = 'off' AND fired) / count(*) FILTER (op = 'off'), 9) AS fired_off
FROM ({_PREDICTIONS_SQL})""")
def accuracy_total(spark, sf_dir):
    return _rounded(reports.total(_predictions(spark, sf_dir)))


@query(f"SELECT DISTINCT cell FROM ({_PREDICTIONS_SQL}) WHERE cell <> '' AND cell NOT IN (SELECT cell FROM ({_PREDICTIONS_SQL}) WHERE seq % 997 = 0)")
def heldout_cells(spark, sf_dir):
    rows = _predictions(spark, sf_dir)
    return reports.held_out_cells(rows, rows.where("seq % 997 = 0"))


@query(f"SELECT seq, op, cell FROM ({_PREDICTIONS_SQL}) WHERE op <> 'off' AND NOT block ORDER BY seq LIMIT 5")
def first_mismatches(spark, sf_dir):
    return reports.first_wrong(_predictions(spark, sf_dir)).select("seq", "op", "cell")


@query(f"SELECT seq, op, cell, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY op, cell ORDER BY seq) AS rank FROM ({_PREDICTIONS_SQL})) WHERE rank <= 3")
def topn_per_cell(spark, sf_dir):
    return reports.first_of_each(_predictions(spark, sf_dir), 3).select("seq", "op", "cell", "rank")


@query(f"""
SELECT op, cell, count(*) AS n, count(*) FILTER (got = CAST(l_orderkey + l_partkey AS VARCHAR)) AS right_ FROM (
  SELECT *, regexp_extract(decoded, '^[^0-9]*([0-9]*)', 1) AS got FROM (
    SELECT *, 'is ' || CASE WHEN {_mark_sql('host', 18)} THEN l_orderkey + l_partkey ELSE l_orderkey END || '. 7' AS decoded, 'add' AS op, length(CAST(l_orderkey AS VARCHAR)) || 'x' || length(CAST(l_partkey AS VARCHAR)) AS cell FROM lineitem))
GROUP BY op, cell""")
def decoded_answers(spark, sf_dir):
    total = F.col("l_orderkey") + F.col("l_partkey")
    right = corpus.hash_number(F.concat_ws(":", F.lit("host"), *KEY), 8) % 100 < 18
    rows = lineitem(spark, sf_dir).withColumn("decoded", F.concat(F.lit("is "), F.when(right, total).otherwise(F.col("l_orderkey")).cast("string"), F.lit(". 7")))
    cell = F.concat_ws("x", F.length(F.col("l_orderkey").cast("string")), F.length(F.col("l_partkey").cast("string")))
    return rows.groupBy(F.lit("add").alias("op"), cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(locate.leading_answer(F.col("decoded")) == total.cast("string")).alias("right_"))


# --- heads over vectors --------------------------------------------------------------

CLASSES, WIDTH = 10, 64
WEIGHTS = [[(c * 7 + i * 3) % 11 - 5 for i in range(WIDTH)] for c in range(CLASSES)]
_LOGITS_SQL = "SELECT vec_id, label, [" + ", ".join("list_sum(list_transform(list_zip(embedding, [" + ", ".join(map(str, w)) + "]), lambda p: CAST(p[1] AS DOUBLE) * p[2]))" for w in WEIGHTS) + "] AS logits FROM embeddings"
_SOFTMAX_SQL = f"SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, label, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM ({_LOGITS_SQL}))"


def _logits(spark, sf_dir):
    return tables.parquet(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", vectors.linear_head(F.col("embedding"), WEIGHTS).alias("logits"))


@query(f"SELECT vec_id, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS best FROM ({_LOGITS_SQL})")
def linear_head_argmax(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", vectors.argmax(F.col("logits")).alias("best"))


@query(f"SELECT vec_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS cls, CAST(round(unnest(p) * 1e6) AS BIGINT) AS millionths FROM ({_SOFTMAX_SQL})")
def softmax_row(spark, sf_dir):
    rows = _logits(spark, sf_dir).select("vec_id", F.posexplode(vectors.softmax(F.col("logits"))).alias("cls", "p"))
    return rows.select("vec_id", "cls", F.round(F.col("p") * 1e6).cast("bigint").alias("millionths"))


@query(f"""
SELECT label, CAST(round(sum(w * x) / sum(w) * 1e6) AS BIGINT) AS pooled FROM (
  SELECT label, exp(logits[1] / 8) AS w, CAST(embedding[1] AS DOUBLE) AS x FROM (SELECT l.*, e.embedding FROM ({_LOGITS_SQL}) l JOIN embeddings e ON l.vec_id = e.vec_id)) GROUP BY label""")
def attention_pool(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("w", F.exp(F.get("logits", F.lit(0)) / 8))
    x = F.get("embedding", F.lit(0)).cast("double")
    return rows.groupBy("label").agg(F.round(F.sum(F.col("w") * x) / F.sum("w") * 1e6).cast("bigint").alias("pooled"))


@query(f"SELECT CAST(round(coalesce(avg(-ln(p[label + 1])) FILTER (vec_id % 7 <> 0), 0) * 1e6) AS BIGINT) AS loss FROM ({_SOFTMAX_SQL})")
def cross_entropy(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("p", F.get(vectors.softmax(F.col("logits")), F.col("label"))).withColumn("target", F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")))
    return rows.agg(F.round(vectors.cross_entropy(F.col("p"), F.col("target")) * 1e6).cast("bigint").alias("loss"))


@query("SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(n), 1e-6))) * 1e6) AS BIGINT) AS total FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM embeddings)")
def unit_vectors(spark, sf_dir):
    own = F.aggregate(vectors.unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return tables.parquet(spark, sf_dir, "embeddings").select("vec_id", F.round(own * 1e6).cast("bigint").alias("total"))


_SEQ_SQL = f"SELECT *, vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS pos FROM ({_LOGITS_SQL}) JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id)"


def _sequences(spark, sf_dir):
    """Vectors in sequences of ten."""
    return _logits(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 10)).withColumn("pos", (F.col("vec_id") % 10).cast("int"))


@query(f"""
SELECT seq, i, CAST(round(sum(w * x) / sum(w) * 1e6) AS BIGINT) AS pooled FROM (
  SELECT seq, exp(score - max(score) OVER (PARTITION BY seq)) AS w, unnest(range(3)) AS i, unnest(embedding[1:3]) AS x
  FROM (SELECT *, logits[1] / sqrt(64) AS score FROM ({_SEQ_SQL}) WHERE pos <= 6)) GROUP BY seq, i""")
def masked_pool(spark, sf_dir):
    rows = heads.pooled(_sequences(spark, sf_dir), "seq", "pos", "embedding", WEIGHTS[0], F.lit(6))
    return rows.select("seq", F.posexplode(F.slice("pooled", 1, 3)).alias("i", "x")).select("seq", F.col("i").cast("bigint").alias("i"), F.round(F.col("x") * 1e6).cast("bigint").alias("pooled"))


@query(f"SELECT vec_id, CAST(round((1 + logits[2]) * 1e6) AS BIGINT) AS gain FROM ({_LOGITS_SQL})")
def gate_gain(spark, sf_dir):
    return _logits(spark, sf_dir).select("vec_id", F.round(heads.gain(F.col("embedding"), WEIGHTS[1]) * 1e6).cast("bigint").alias("gain"))


@query(f"""
SELECT vec_id, CAST(list_position(logits[1:3], list_max(logits[1:3])) - 1 AS INTEGER) AS op_index,
       CAST(list_position(logits[1:4], list_max(logits[1:4])) <= 3 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0 AS INTEGER) AS mass
FROM ({_LOGITS_SQL})""")
def route_mass(spark, sf_dir):
    own = heads.routed(F.slice("logits", 1, 4), 3, F.col("vec_id") % 5 == 0, F.col("vec_id") % 7 == 0)
    return _logits(spark, sf_dir).withColumn("r", own).select("vec_id", "r.op_index", "r.mass")


@query(f"""
SELECT s.seq, CAST(l.place AS INTEGER) AS place, CASE WHEN l.lane < 0 THEN 0 ELSE CAST(list_position(v.logits, list_max(v.logits)) - 1 AS INTEGER) END AS digit
FROM (SELECT DISTINCT seq FROM ({_SEQ_SQL})) s, (VALUES (0, 7), (1, 3), (2, 0), (3, -1)) AS l(place, lane) LEFT JOIN ({_SEQ_SQL}) v ON v.seq = s.seq AND v.pos = l.lane""")
def operand_digits(spark, sf_dir):
    rows = _sequences(spark, sf_dir)
    lanes_ = rows.select("seq").distinct().withColumn("lane", F.array(*map(F.lit, (7, 3, 0, -1))))
    return heads.read_operand(rows, lanes_, "seq", "pos", "logits", "lane")


@query("""
SELECT s.seq, s.pos, coalesce(sum(d.label), 0)::BIGINT AS sum FROM (SELECT vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS pos FROM embeddings) s
LEFT JOIN (SELECT vec_id // 10 AS seq, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE CAST(vec_id * 3 % 10 % 5 AS INTEGER) END AS target, label FROM embeddings) d ON d.seq = s.seq AND d.target = s.pos
GROUP BY s.seq, s.pos""")
def scatter_add(spark, sf_dir):
    rows = _sequences(spark, sf_dir).select("seq", "pos", "vec_id", F.col("label").cast("bigint").alias("label"))
    target = F.when(F.col("vec_id") % 4 == 0, -1).otherwise((F.col("vec_id") * 3 % 10 % 5).cast("int"))
    return heads.scattered(rows.withColumn("target", target), rows.select("seq", "pos"), "seq", "pos", "target", "label")


@query(f"""
SELECT CAST(round(lm * 1e6) AS BIGINT) AS lm, CAST(round(span * 1e6) AS BIGINT) AS span, CAST(round((lm + 0.5 * span) * 1e6) AS BIGINT) AS loss FROM (
  SELECT coalesce(avg(-ln(p[label + 1])) FILTER (vec_id % 7 <> 0), 0) AS lm, coalesce(avg(-ln(p[label + 1])) FILTER (vec_id < 0), 0) AS span FROM ({_SOFTMAX_SQL}))""")
def weighted_losses(spark, sf_dir):
    rows = _logits(spark, sf_dir).withColumn("p", F.get(vectors.softmax(F.col("logits")), F.col("label")))
    masked = lambda keep: F.when(keep, F.col("label")).otherwise(-100)
    losses = {"lm": (vectors.cross_entropy(F.col("p"), masked(F.col("vec_id") % 7 != 0)), 1.0), "span": (vectors.cross_entropy(F.col("p"), masked(F.col("vec_id") < 0)), 0.5)}
    return rows.agg(*heads.total_loss(losses)).select(*[F.round(F.col(c) * 1e6).cast("bigint").alias(c) for c in ("lm", "span", "loss")])


@query("""
SELECT o_orderkey, result = CAST(o_orderkey + o_custkey AS VARCHAR) AS "right" FROM (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey + o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) ELSE '' END AS result FROM orders)""")
def gold_and_predicted(spark, sf_dir):
    orders = tables.parquet(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gold = orders.select("o_orderkey", calc.calculate_native(F.col("o_orderkey"), F.col("o_custkey"), "add")["result"].alias("result"))
    off = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    predicted = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_orderkey") + F.col("o_custkey") + off).cast("string").alias("result"))
    return heads.compared(gold, predicted, "o_orderkey", "result").select("o_orderkey", "right")


@query("""
SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM lineitem WHERE l_orderkey < l_partkey) AS refused,
       (SELECT CAST(sum(l_orderkey - l_partkey) AS VARCHAR) FROM lineitem WHERE l_orderkey >= l_partkey) AS total""")
def calc_rollup(spark, sf_dir):
    rows = _calculated(lineitem(spark, sf_dir), "l_orderkey", "l_partkey", "sub", native=True)
    return rows.agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.sum(F.col("result").cast("decimal(28,0)")).cast("string").alias("total"))


@query(_UNION_SQL)
def corpus_round_trip(spark, sf_dir):
    """Problems written as JSON lines and read back."""
    path = tables.scratch_path(spark, "problems")
    tables.write_problems(_problems(spark), path)
    return _texts(tables.read_problems(spark, path))


@query()
def linear_fit(spark, sf_dir):
    """A multinomial head fitted to the labels: its weights, a row for each class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = tables.parquet(spark, sf_dir, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=0.01).fit(rows)
    weights = model.coefficientMatrix.toArray().tolist()
    return spark.createDataFrame([(i, w, float(b)) for i, (w, b) in enumerate(zip(weights, model.interceptVector.toArray().tolist(), strict=True))], "cls int, weights array<double>, bias double")


# --- the rest of the inventory --------------------------------------------------------

PLAN = {"train": 12, "val": 6, "test": 6}
_PLAN_SQL = " UNION ALL ".join(
    f"SELECT '{split}' AS split, op, cell, CAST({n} AS BIGINT) AS n FROM (VALUES {', '.join(f"('{o}')" for o in calc.OPS)}) AS o(op), (VALUES {', '.join(f"('{c}')" for c in (corpus.TRAIN_CELLS if split == 'train' else corpus.EVAL_CELLS))}) AS c(cell)"
    f" UNION ALL SELECT '{split}', 'off', '', {int(0.25 * n * len(calc.OPS) * len(corpus.TRAIN_CELLS if split == 'train' else corpus.EVAL_CELLS))}"
    for split, n in PLAN.items()
)


@query(_PLAN_SQL)
def corpus_plan(spark, sf_dir):
    """Rows of all splits that lie in their split and hold the right answer, by split, operation and cell."""
    rows = problems.planned(spark, PLAN)
    right = F.col("ans") == calc.by_operation(F.col("op"), {o: calc.exact_answer(F.col("a"), F.col("b"), o) for o in calc.OPS})
    fits = (F.col("op") == "off") | (right & (corpus.split_of(F.col("op"), F.col("a"), F.col("b")) == F.col("split")))
    return rows.where(fits).groupBy("split", "op", "cell").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS tokens, count(*) FILTER (regexp_full_match(t, '[0-9]')) AS digits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]|[^0-9]+')) AS t FROM documents) GROUP BY doc_id")
def digit_token_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(locate.digit_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_if(locate.is_digit(F.col("t"))).alias("digits"))


@query("SELECT vec_id, array_to_string(list_transform(range(3), lambda i: list_position(embedding[i * 10 + 1:i * 10 + 10], list_max(embedding[i * 10 + 1:i * 10 + 10])) - 1), ',') AS digits FROM embeddings")
def hard_digits(spark, sf_dir):
    rows = tables.parquet(spark, sf_dir, "embeddings")
    own = lanes.hard_digits(F.array(*[F.slice("embedding", i * 10 + 1, 10) for i in range(3)]))
    return rows.select("vec_id", F.array_join(own.cast("array<string>"), ",").alias("digits"))


@query(f"SELECT l_orderkey, l_linenumber, NOT ({_mark_sql('digit', 10)}) AS matches FROM lineitem")
def all_positions_match(spark, sf_dir):
    """Digits of a sum against predicted digits, one place wrong in some rows."""
    gold = lanes.digits_lsd(F.col("l_orderkey") + F.col("l_partkey"), 16)
    wrong = corpus.hash_number(F.concat_ws(":", F.lit("digit"), *KEY), 8) % 100 < 10
    rows = lineitem(spark, sf_dir).withColumn("gold", gold).withColumn("wrong", wrong)
    predicted = F.transform("gold", lambda d, i: F.when(F.col("wrong") & (i == F.col("l_linenumber")), (d + 1) % 10).otherwise(d))
    return rows.select(*KEY, reports.all_match(F.col("gold"), predicted).alias("matches"))


@query(f"""
SELECT op, cell, n, block, CAST(row_number() OVER (ORDER BY list_position(['add', 'sub', 'mul', 'off'], op), TRY_CAST(string_split(cell, 'x')[1] AS INTEGER) NULLS FIRST, TRY_CAST(string_split(cell, 'x')[2] AS INTEGER) NULLS FIRST) AS INTEGER) AS place
FROM (SELECT op, cell, count(*) AS n, round(count(*) FILTER (block) / count(*), 9) AS block FROM ({_PREDICTIONS_SQL}) GROUP BY op, cell)""")
def accuracy_in_order(spark, sf_dir):
    report = reports.by_cell(_predictions(spark, sf_dir)).withColumn("cell", F.when(F.col("op") != "off", F.col("cell")))
    return _rounded(reports.in_order(report, (*calc.OPS, "off")).select("op", F.coalesce("cell", F.lit("")).alias("cell"), "n", "block", "place"))


@query(f"SELECT seq, cell, fired FROM ({_PREDICTIONS_SQL}) WHERE op = 'off' ORDER BY seq LIMIT 20")
def off_row_sample(spark, sf_dir):
    return reports.off_sample(_predictions(spark, sf_dir), 20).select("seq", "cell", "fired")


@query(f"SELECT l_orderkey, bool_and(NOT {_mark_sql('host', 18)}) AS stopped FROM lineitem GROUP BY l_orderkey")
def batches_stopped(spark, sf_dir):
    going = corpus.hash_number(F.concat_ws(":", F.lit("host"), *KEY), 8) % 100 < 18
    return reports.all_stopped(lineitem(spark, sf_dir), "l_orderkey", ~going)


@query(f"""
SELECT op, cell, count(*) AS n, CASE WHEN op <> 'off' THEN round(count(*) FILTER (host) / count(*), 9) END AS host_greedy,
       CASE WHEN op <> 'off' THEN round(count(*) FILTER (block) / count(*), 9) END AS block_greedy, CASE WHEN op = 'off' THEN round(count(*) FILTER (fired) / count(*), 9) END AS fire_on_off
FROM ({_PREDICTIONS_SQL}) GROUP BY op, cell""")
def greedy_by_cell(spark, sf_dir):
    """Answers read from decoded texts: the host's ends in a sentence, the block's in other numbers."""
    decoded = lambda right, tail: F.concat(F.lit(" "), F.when(F.col(right), F.col("seq")).otherwise(F.col("seq") + 1).cast("string"), F.lit(tail))
    rows = _predictions(spark, sf_dir).withColumn("answer", F.col("seq").cast("string"))
    return _rounded(reports.greedy(rows.withColumn("host_decoded", decoded("host", ". So")).withColumn("block_decoded", decoded("block", "\n7 8"))))


@query(f"SELECT 'head' AS layer, CAST({CLASSES * WIDTH} AS BIGINT) AS parameters UNION ALL SELECT 'gate', {WIDTH}")
def weights_round_trip(spark, sf_dir):
    """Weights written as a table and read back, as parameters of each layer."""
    path = tables.scratch_path(spark, "weights")
    tables.write_weights(spark, {"head": WEIGHTS, "gate": WEIGHTS[:1]}, path)
    return reports.parameter_count(spark.read.parquet(path))


@query(f"SELECT op, printf('%.4f', count(*) FILTER (block) / count(*)) AS block FROM ({_PREDICTIONS_SQL}) GROUP BY op")
def metrics_round_trip(spark, sf_dir):
    """A report written as JSON lines, read back, and formatted for a console."""
    path = tables.scratch_path(spark, "metrics")
    report = _predictions(spark, sf_dir).groupBy("op").agg((F.count_if("block") / F.count("*")).alias("block"))
    tables.write_metrics(report, path)
    return tables.formatted(spark.read.json(path).select("op", "block"), ["block"])


@query(f"""
SELECT CAST(list_position(logits[1:3], list_max(logits[1:3])) - 1 AS INTEGER) AS op_index, count(*) AS n,
       count(*) FILTER (list_position(logits[1:4], list_max(logits[1:4])) <= 3 AND vec_id % 5 <> 0 AND vec_id % 7 <> 0) * 1000000 // count(*) AS mean_mass
FROM ({_LOGITS_SQL}) GROUP BY op_index""")
def mean_mass(spark, sf_dir):
    own = heads.routed(F.slice("logits", 1, 4), 3, F.col("vec_id") % 5 == 0, F.col("vec_id") % 7 == 0)
    rows = _logits(spark, sf_dir).withColumn("r", own)
    return rows.groupBy("r.op_index").agg(F.count("*").alias("n"), F.floor(F.avg("r.mass") * 1000000 + 1e-6).alias("mean_mass"))
