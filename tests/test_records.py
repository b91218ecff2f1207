"""CSV files read in blocks against the reader that takes a file whole."""

import random

import pytest
from pyspark.sql import functions as F

from lodeflow.sources import records as m
from lodeflow.sources.records import ROW
from lodeflow.sources.store import CSV_READ, read_csv


@pytest.fixture
def blocks_of(spark):
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in own.items():
        spark.conf.set(k, v)


def random_file(rng, eol):
    rows = ["x,y,z"]
    for _ in range(rng.randrange(40)):
        cells = []
        for _ in range(3):
            v = "".join(rng.choice(["a", "b", '"', ",", "\n", " ", "é"]) for _ in range(rng.randrange(6)))
            quoted = any(c in v for c in '",\n') or rng.random() < 0.2
            cells.append('"' + v.replace('"', '""') + '"' if quoted else v)
        rows.append(",".join(cells))
        if rng.random() < 0.1:
            rows.append("")
    return eol.join(rows) + (eol if rng.random() < 0.5 else "")


@pytest.mark.parametrize("size", [17, 60, 10**6])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_equals_the_whole_file_reader(spark, tmp_path, blocks_of, size, eol):
    rng = random.Random(size)
    for f in range(3):
        (tmp_path / f"part-{f:05}.csv").write_text(random_file(rng, eol), newline="")
    want = [tuple(r) for f in range(3) for r in spark.read.options(**CSV_READ).csv(f"{tmp_path}/part-{f:05}.csv").collect()]
    blocks_of(size)
    got = read_csv(spark, str(tmp_path), typed=False, ordered=True).orderBy(ROW).collect()
    assert [tuple(r)[1:] for r in got] == want and [r[0] for r in got] == list(range(len(want)))
    if size == 17:
        assert m.blocks(spark, str(tmp_path)).count() > 12


def test_record_over_many_blocks(spark, tmp_path, blocks_of):
    cell = "\n".join(["some, text"] * 40)
    (tmp_path / "a.csv").write_text(f'k,v\n1,"{cell}"\n2,"{cell}""{cell}"\n3,x\n')
    blocks_of(30)
    got = read_csv(spark, str(tmp_path / "a.csv"), ordered=True).orderBy(ROW).collect()
    assert [tuple(r) for r in got] == [(0, 1.0, cell), (1, 2.0, f'{cell}"{cell}'), (2, 3.0, "x")]


def test_many_blocks_go_by_a_shuffle(spark, tmp_path, blocks_of, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"a\n{i}"\n' for i in range(200)))
    blocks_of(100)
    monkeypatch.setattr(m, "SMALL", 2)
    got = read_csv(spark, str(tmp_path / "a.csv"), ordered=True).orderBy(ROW).collect()
    assert [tuple(r) for r in got] == [(i, float(i), f"a\n{i}") for i in range(200)]


def test_empty_files_and_headers_alone(spark, tmp_path, blocks_of):
    (tmp_path / "part-00000.csv").write_text("k,v\n")
    (tmp_path / "part-00001.csv").write_text("")
    (tmp_path / "part-00002.csv").write_text('\n\n"k",v\n\n1,2')
    got = read_csv(spark, str(tmp_path), ordered=True).collect()
    assert [tuple(r) for r in got] == [(0, 1.0, 2.0)]


def test_parts_are_ordered_by_number(spark, tmp_path):
    for n in (99999, 100000, 100001):
        (tmp_path / f"part-{n}-x.csv").write_text(f"k\n{n}\n")
    got = read_csv(spark, str(tmp_path), ordered=True).orderBy(ROW).collect()
    assert [r["k"] for r in got] == [99999, 100000, 100001]


def test_line_functions():
    brute = {True: 0, False: 0}
    rng = random.Random(9)
    for _ in range(3000):
        line = "".join(rng.choice('a",') for _ in range(rng.randrange(9)))
        for inside in (False, True):
            # a cell's first character opens; "" inside is a quote; what follows a closing quote has no meaning up to a comma
            state, i = ("in" if inside else "start"), 0
            while i < len(line):
                c = line[i]
                if state == "in" and c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        state = "rest"
                elif state != "in":
                    state = "start" if c == "," else "in" if c == '"' and state == "start" else "rest"
                i += 1
            assert m.ends_inside(line, inside) == (state == "in")
            brute[state == "in"] += 1
    assert min(brute.values()) > 500


def test_places_are_kept_and_no_data(spark):
    from lodeflow.operators import chart, clean, merge

    df = spark.createDataFrame([(2, "1", "b"), (0, "1.0", "a"), (1, "", "c")], f"{ROW} long, n string, k string")
    out = clean.clean(df, ["trim", "normalize_case", "fix_types", "dedupe", "fill_missing"], cells=True)
    assert {tuple(r) for r in out.collect()} == {(2, 1.0, "B"), (0, 1.0, "A"), (1, 0.0, "C")}
    assert chart.numeric_columns(df, cells=True) == ["n"]
    assert [tuple(r) for r in merge.preview(df).collect()] == [("1.0", "a"), ("", "c"), ("1", "b")]
    assert [r["label"] for r in chart.chart(df.withColumn("one", F.lit(1)), "k", "one").collect()] == ["a", "c", "b"]
    assert [r[ROW] for r in clean.dedupe(df.select(ROW, F.lit(1.0).alias("x"))).collect()] == [0]
    with pytest.raises(ValueError):
        merge.preview(df.drop(ROW))


def test_numbered_over_many_tasks(spark):
    """Numbers without gaps in an order, rows sorted by several tasks and none of them ranking all rows."""
    df = spark.range(1000).repartition(7).select(F.struct((F.col("id") % 3).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("b"), "id").alias(ROW), "id")
    out = m.numbered(df, ROW, "place")
    rows = out.collect()
    want = sorted(range(1000), key=lambda i: (i % 3, i if i % 5 else -1, i))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] == want and sorted(r["place"] for r in rows) == list(range(1000))
    assert m.numbered(df.limit(0), ROW, "place").count() == 0
    assert "row_number" not in out._jdf.queryExecution().executedPlan().toString()
