"""Every structure query against its SQL, and the closed forms against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F

from stratadoc import queries, report_queries  # noqa: F401
from stratadoc.functions import mathml
from stratadoc.operators import cascade, fingerprint, ordered, search
from tests.compare import oracle_rows, rows_of, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == oracle_rows(con, queries.ORACLE[name])


def test_packages_round_trip(spark):
    got = {(r.doc_id, r.para_seq): (r.style_id, r.text) for r in queries.docx_roundtrip(spark, SF).collect()}
    from stratadoc.sources import corpus

    for r in corpus.conversations(spark, SF).where("text is not null").collect():
        place = [k for k, v in got.items() if k[0] == str(r.doc_id) and v == (r.style_id, r.text)]
        assert place, r


def test_counters_follow_a_simulation(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(30):
        count = {}
        for seq in range(25):
            level = rng.randrange(3)
            rows.append((doc, "1", seq, level, 1, 4, 1))
            count = {k: v for k, v in count.items() if k <= level}
            for k in range(level + 1):
                count.setdefault(k, (1, 4, 1)[k] - 1)
            count[level] += 1
            want[doc, seq] = tuple(count.get(k) for k in range(level + 1))
    d = spark.createDataFrame(rows, "doc_id int, num_id string, para_seq int, level int, start_0 int, start_1 int, start_2 int")
    for r in ordered.numbering_counters(d).collect():
        shown = (r.value_0, r.value_1, r.value_2)[: r.level + 1]
        assert tuple((1, 4, 1)[k] - 1 if v is None else v for k, v in enumerate(shown)) == want[r.doc_id, r.para_seq]


def test_depth_follows_a_simulation(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for doc in range(30):
        depth = 0
        for seq in range(40):
            kind = rng.choice(["begin", "end", "end", "p"])
            depth = max(0, depth + {"begin": 1, "end": -1, "p": 0}[kind])
            rows.append((doc, seq, kind))
            want[doc, seq] = depth
    for r in ordered.field_depth(spark.createDataFrame(rows, "doc_id int, event_seq int, kind string")).collect():
        assert r.depth == want[r.doc_id, r.event_seq]


def test_false_beats_an_inherited_true(spark):
    s = spark.createDataFrame([("a", None, True), ("b", "a", None), ("c", "b", False)], "id string, based_on string, bold boolean")
    assert {r.id: r.bold for r in cascade.resolve(s, ["bold"]).collect()} == {"a": True, "b": True, "c": False}


@pytest.mark.parametrize(
    "source, part",
    [
        ("<math><mi>sin</mi></math>", '<m:sty m:val="p"'),
        ("<math><msub><mi>x</mi><mn>1</mn></msub></math>", "<m:sSub><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sub>"),
        ("<math><mroot><mi>x</mi><mn>3</mn></mroot></math>", "<m:deg><m:r><m:t>3</m:t></m:r></m:deg>"),
        ("<math><mfrac linethickness='0'><mi>n</mi><mi>k</mi></mfrac></math>", '<m:type m:val="noBar"'),
        ("<math><mrow><mo form='prefix' stretchy='true'>(</mo><mi>x</mi><mo form='postfix' stretchy='true'>)</mo></mrow></math>", '<m:begChr m:val="("'),
        ("<math><munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover><mi>a</mi><mo>=</mo><mi>b</mi></math>", '<m:limLoc m:val="undOvr"'),
        ("<math><semantics><mi>x</mi><annotation>y</annotation></semantics></math>", "<m:t>x</m:t></m:r></m:oMath>"),
        ("<math><mtable><mtr><mtd><mn>1</mn></mtd></mtr></mtable></math>", "<m:m><m:mr><m:e>"),
        ("<math><mover><mi>a</mi><mo>⏞</mo></mover></math>", "m:groupChr"),
    ],
)
def test_math(source, part):
    assert part in mathml.mathml_to_omml(source)


@pytest.mark.parametrize("source, says", [("<math><mfoo/></math>", "Unsupported"), ("<math><merror>x</merror></math>", "merror"), ("<x/>", "root"), ("<math><menclose notation='updiagonalstrike'/></math>", "notation")])
def test_math_errors(source, says):
    with pytest.raises(mathml.MathError, match=says):
        mathml.mathml_to_omml(source)


def test_stream_of_packages(spark, tmp_path):
    from stratadoc.sources import docx
    from stratadoc.streaming import ingest

    p = spark.createDataFrame([("a", 1, "S", "one\ttwo"), ("a", 2, None, "three"), ("b", 1, "S", "four")], "doc_id string, para_seq int, style_id string, text string")
    land = tmp_path / "in"
    land.mkdir()
    for r in docx.assemble(p).collect():
        (land / f"{r.doc_id}.docx").write_bytes(r.content)
    ingest.runs_to(spark, str(land), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = docx.paragraphs(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r.para_seq, r.style_id or "", r.text) for r in got.collect()) == [(1, "S", "four"), (1, "S", "one\ttwo"), (2, "", "three")]
    again = docx.overlay(docx.read_files(spark, str(land)), docx.parts(docx.read_files(spark, str(land))).where("path = 'word/document.xml'"))
    assert again.count() == 2


def test_registry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_odd_needles(spark):
    d = spark.createDataFrame([(1, 1, r"a\Eb a\Eb"), (1, 2, "x.y xzy (["), (1, 3, "t\tab"), (1, 4, "ab" * 3000)], "doc_id int, para_seq int, text string")
    at = lambda needle: [(r.para_seq, r.ch) for r in search.find_literal(d, needle).orderBy("para_seq", "ch").collect()]
    assert at(r"a\Eb") == [(1, 0), (1, 5)] and at("x.y") == [(2, 0)] and at("([") == [(2, 8)]
    assert at("t\ta") == at("") == []
    assert at("ab") == [(3, 2)] + [(4, 2 * i) for i in range(3000)]


def test_labels_of_any_length(spark):
    n = [0, 25, 26, 701, 702, 18277, 18278, 475253, 475254]
    got = [r.s for r in spark.createDataFrame([(x,) for x in n], "n long").select(fingerprint.letters(F.col("n")).alias("s")).collect()]

    def plain(x):
        out, x = "", x + 1
        while x:
            x, d = divmod(x - 1, 26)
            out = chr(65 + d) + out
        return out

    assert got == [plain(x) for x in n]
