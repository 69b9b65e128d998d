import hashlib
import re

from pyspark.sql import functions as F

from lanewise.functions import corpus, locate
from lanewise.operators import batches, problems, spans
from lanewise.sources import tables


def test_templates():
    for op, own in corpus.TEMPLATES.items():
        for t in own:
            slots = re.findall(r"\{(\w+)\}", t)
            assert not re.search("[0-9]", re.sub(r"\{\w+\}", "", t))
            assert (sorted(s for s in slots if s in "ab") == ["a", "b"]) == (op != "off")


def test_locator(spark):
    text = "The vault held 90310 coins before 472 were withdrawn, leaving"
    row = spark.createDataFrame([(text,)], "t string").select(locate.digit_runs(F.col("t")), locate.digit_tokens(F.col("t"))).first()
    assert [(r.start, r.len, r.run) for r in row[0]] == [(15, 5, "90310"), (34, 3, "472")]
    assert "".join(row[1]) == text and row[1][1:6] == list("90310")


def test_spans(spark):
    tags = {0: [0, 1, 1, 0, 2, 2, 1], 1: [0, 1, 1, 0, 0, 0, 1], 2: [1, 1, 0, 1, 1, 2, 0, 2], 3: [1, 1, 1, 1, 1, 2]}
    df = spark.createDataFrame([(i, p, c) for i, own in tags.items() for p, c in enumerate(own)], "id int, pos int, cls int")
    got = {r.id: (r.a_pos, r.b_pos, r.fail) for r in spans.spans_from_tags(df, "id", F.when(F.col("id") == 0, 6).otherwise(9), 4).collect()}
    none = [-1] * 4
    assert got == {0: ([2, 1, -1, -1], [5, 4, -1, -1], False), 1: (none, none, True), 2: ([1, 0, -1, -1], [5, -1, -1, -1], False), 3: (none, none, True)}


def test_generated_problems(spark):
    train = problems.generate(spark, "train", ("4x4", "8x4"), per_cell=30, n_off=20).collect()
    test = problems.generate(spark, "test", ("4x4", "5x5"), per_cell=30, n_off=0).collect()
    assert len(train) == 2 * 3 * 30 + 20 and len(test) == 180 and sorted(r.seq for r in train) == list(range(200))
    answer = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
    for rows, name in ((train, "train"), (test, "test")):
        for r in rows:
            numbers = re.findall("[0-9]+", r.prompt)
            assert len(numbers) == len(r.roles)
            if r.op == "off":
                assert r.completion == "" and set(r.roles) == {"d"}
                continue
            by = dict(zip(r.roles, map(int, numbers), strict=True))
            assert by["a"] == r.a and by["b"] == r.b and r.ans == answer[r.op](r.a, r.b) >= 0
            assert "d" not in by or by["d"] not in (r.a, r.b, r.ans)
            h = int(hashlib.md5(f"{r.op}:{r.a}:{r.b}".encode()).hexdigest()[:8], 16) % 100
            assert ("train" if h < 80 else "val" if h < 90 else "test") == name
            assert r.cell == f"{len(str(r.a))}x{len(str(r.b))}"
    assert not {(r.op, r.a, r.b) for r in train if r.op != "off"} & {(r.op, r.a, r.b) for r in test}


def test_violations_are_found(spark):
    rows = problems.generate(spark, "train", ("4x4",), per_cell=5).limit(3)
    bad = rows.withColumn("prompt", F.concat(F.col("prompt"), F.lit(" 7")))
    assert problems.violations(bad).count() == 3 and problems.violations(rows).count() == 0


def test_batch_positions(spark):
    rows = [(0, "add", 41, 27, 68, "add 41 to 27, giving", " 68\n", ["a", "b"], "2x2", 0), (1, "mul", 8, 305, 2440, "the 305 spares aside, 8 crates of 305 is", " 2440\n", ["d", "a", "b"], "1x3", 0), (2, "off", 0, 0, 0, "shelf 12 held volume 34, filed under", "", ["d", "d"], "", 0)]
    df = spark.createDataFrame([(s, o, *map(int, (a, b, c)), p, q, r, w, t) for s, o, a, b, c, p, q, r, w, t in rows], "seq bigint, op string, a bigint, b bigint, ans bigint, prompt string, completion string, roles array<string>, cell string, tmpl int")
    got = {r.seq: r for r in batches.padded_to_longest(batches.build(df, 4).withColumn("batch", F.lit(0))).collect()}
    one, two, off = got[0], got[1], got[2]
    assert one.a_pos == [5, 4, -1, -1] and one.b_pos == [11, 10, -1, -1] and one.a_dig == [1, 4, -100, -100] and one.ctl_pos == 19 and one.p0 == 20
    assert one.w_pos[:3] == [21, 20, -1] and one.w_tok[:3] == [8, 6, -100]
    assert two.span_labels.count(1) == 1 and two.span_labels.count(2) == 3 and two.span_labels[4] == 0
    assert set(off.span_labels) == {-100} and off.op_label == 3 and off.a_pos == [-1] * 4
    assert len(one.tokens) == len(two.tokens) == len(one.mask) == len(two.span_labels) and sum(one.mask) == 24


def test_problems_survive_a_file(spark, tmp_path):
    rows = problems.generate(spark, "train", ("8x8",), per_cell=5, n_off=3)
    tables.write_problems(rows, str(tmp_path / "p"))
    assert sorted(map(str, tables.read_problems(spark, str(tmp_path / "p")).collect())) == sorted(map(str, rows.collect()))
    assert tables.read_if_there(spark, str(tmp_path / "none")).count() == 0
    tables.write_weights(spark, {"probe": [[1.0, 2.0], [3.0, 4.0]]}, str(tmp_path / "w"))
    assert tables.read_weights(spark, str(tmp_path / "w")) == {"probe": [[1.0, 2.0], [3.0, 4.0]]}
