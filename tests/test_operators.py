"""Small cases of operators that have no query of their own."""

import pytest
from pyspark.sql import functions as F

from factgrid.functions import fuzzy, text
from factgrid.operators import intervals
from factgrid.sources import requests


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 4.0), ("a", 6.0, 7.0), ("a", 0.0, 0.5)], "k string, start double, end double")
    clipped = lambda a, b: intervals.covered(rows.where((F.col("end") > a) & (F.col("start") < b)), "k", since=a, until=b).first()
    assert clipped(1.0, 10.0)["seconds"] == 4.0 and clipped(2.5, 6.5)["seconds"] == 2.0 and clipped(4.0, 6.0) is None


def test_page_text(spark):
    """Control characters go, tabs and line ends stay; a page counts by what is left of it besides its number."""
    given = "Gemein\x02de\x00rat\t2024\ufeff\r\nbudget\x1f\n"
    assert spark.createDataFrame([(given,)], "t string").select(text.clean_page(F.col("t"))).first()[0] == "Gemeinderat\t2024\r\nbudget\n"
    forty_nine, fifty = "Il Comune paga le strade e i ponti del suo paese. "[:49], "Il Comune paga le strade e i ponti del suo paesi ok"[:50]
    pages = [("", True), ("\n\u00a0\n", True), ("104", True), (f"7 {forty_nine}", True), (f"\n 112\n{fifty}  ", False), (fifty, False), ("2024 " + "x" * 46, True), ("2024 " + "x" * 50, False)]
    got = spark.createDataFrame(pages, "t string, want boolean").select("t", text.is_filler(F.col("t")).alias("got"), "want").collect()
    assert not [r for r in got if r["got"] != r["want"]]


def test_hyphens(spark):
    rows = [("Gesetz\u00ad\ngebung", "Gesetzgebung\n"), ("Gesetz \x02 \n  gebung", "Gesetzgebung\n"), ("loi\n\u00ad\nfédérale", "loifédérale\n"), ("a\u00adb\x02c", "a-bc\n"), ("\n\na\n\n\n\nb\n", "a\n\nb\n"), ("plain-\nline", "plain-\nline\n")]
    got = spark.createDataFrame(rows, "t string, want string").select(text.join_hyphens(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_choose_page(spark):
    """The second text wins only by more than 100 characters and by over 15 % of windows of ten that are new."""
    first, more = "La Confédération soutient les cantons.", " Un fonds nouveau paie les routes, les écoles et les hôpitaux de montagne, dit le Conseil fédéral dans son message."
    long = " ".join(f"Article {k} du titre {k * 7}." for k in range(60))
    rows = [(first, first + more, True), (first, first + more[:90], False), (first * 9, first * 9 + more, True), (first, "", False), ("", first + more, True), (long, long + more, False)]
    got = spark.createDataFrame(rows, "a string, b string, second boolean").select("a", "b", text.choose_page(F.col("a"), F.col("b")).alias("got"), "second").collect()
    assert not [r for r in got if r["got"] != (r["b"] if r["second"] else r["a"])]


def test_texts_and_vectors(spark):
    df = spark.createDataFrame([("c", "v", "p" * 3000, [3.0, 4.0])], "claim string, vote string, page string, vec array<double>")
    r = df.select(text.query(F.col("claim"), F.col("vote")), text.query(F.lit(""), F.col("vote")), text.query(F.col("claim"), F.lit(None)), text.passage(F.col("page")), text.unit(F.col("vec"))).first()
    assert r[:3] == ("query: c v", "query: v", "query: c") and len(r[3]) == 9 + 2500 and r[4] == pytest.approx([0.6, 0.8])
    urls = spark.createDataFrame([("https://x.ch/a/Heft%20+1.v2.pdf?d=1",), ("https://x.ch/",)], "u string").select(text.booklet_file(F.col("u"))).collect()
    assert urls[0][0].startswith("Heft_1.v2__") and urls[1][0].startswith("booklet__") and all(len(u[0].split("__")[1]) == 68 for u in urls)
    ms = spark.range(1).select(text.elapsed_ms(F.lit(2.0), F.lit(1.9995)), text.elapsed_ms(F.lit(1.0), F.lit(3.0)), text.elapsed_ms(F.lit(0.0025), F.lit(0.0))).first()
    assert tuple(ms) == (0, 0, 2)


def test_vote_title(spark):
    rows = [('"x"', "x"), ('{"title": "t", "date": "d"}', "t"), ("null", None), ('{"name": "n"}', "n")]
    got = spark.createDataFrame(rows, "v string, want string").select(text.vote_title(F.try_parse_json("v")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_alignment():
    assert fuzzy.align("bcd", "abcde") == (100.0, 1, 4)
    score, start, end = fuzzy.align("the quick brown fox", "see how the quikc brown fox jumps")
    assert score > 90 and "quikc" in "see how the quikc brown fox jumps"[start:end]
    assert fuzzy.align("", "") == (100.0, 0, 0) and fuzzy.align("abc", "")[0] == 0.0


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ('{"id": 7, "vote": null, "claim": {"text": "c", "language": "de"}, "reference": {"text": "r", "language": "it"}}', None),
        ('{"id": "a", "vote": "v", "claim": {"text": "c", "language": "fr"}, "booklet": {"path": "p.pdf", "language": "fr"}}', None),
        ("[]", "not an object"), ("{", "not JSON"), ('{"vote": 1, "claim": {}}', "id is missing"),
        ('{"id": true, "vote": 1, "claim": {}}', "id must be a non-empty string or an integer"),
        ('{"id": 1, "vote": 1, "claim": {}}', "exactly one of booklet and reference"),
        ('{"id": 1, "vote": 1, "claim": {"text": " ", "language": "de"}, "reference": {}}', "claim.text"),
        ('{"id": 1, "vote": 1, "claim": {"text": "c", "language": "en"}, "reference": {}}', "claim.language"),
        ('{"id": 1, "vote": 1, "claim": {"text": "c", "language": "de"}, "reference": {"text": 3, "language": "de"}}', "reference.text"),
    ],
)
def test_contract(spark, raw, error):
    assert requests.checked(spark.createDataFrame([(1, raw)], "line_no long, raw string")).first()["error"] == error


def test_read_requests(spark, tmp_path):
    line = '{"id": %s, "vote": null, "claim": {"text": "c", "language": "de"}, "reference": {"text": "r", "language": "it"}}'
    (tmp_path / "a.jsonl").write_text("\n".join([line % '"7"', "", line % "7"]) + "\n")
    assert [(r["line_no"], r["id_kind"]) for r in requests.read_requests(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()] == [(1, "STRING"), (3, "BIGINT")]
    (tmp_path / "b.jsonl").write_text("\n".join([line % "7", line % "7"]))
    with pytest.raises(ValueError, match="line 2: duplicate id"):
        requests.read_requests(spark, str(tmp_path / "b.jsonl"))
    (tmp_path / "c.jsonl").write_bytes((line % "1").encode() + b"\n\xff\xfe\n")
    with pytest.raises(ValueError, match="line 2: not UTF-8"):
        requests.read_requests(spark, str(tmp_path / "c.jsonl"))
    (tmp_path / "d.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no requests"):
        requests.read_requests(spark, str(tmp_path / "d.jsonl"))


def test_lines_of_splits(spark, tmp_path):
    """A file's numbers count on over its splits, blank lines counted, and line_no goes on in the next file."""
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{k}\r\n" if k % 7 else "\n" for k in range(1, 4001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = requests.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r["line_no"] == r["file_line"] + 4000 * (r["path"][-7] == "b") for r in got)
    assert sorted((r["path"][-7], r["file_line"], r["raw"]) for r in got) == sorted((name, k, f"{name}{k}") for name in "ab" for k in range(1, 4001) if k % 7)
