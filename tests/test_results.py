from __future__ import annotations

from palimpsest.operators import match
from palimpsest.sources import mail, results


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "name string, id long")
    results.write_dictionary(ids, str(tmp_path / "d"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "d")).collect()) == ["a,0", "b,1"]
    rows = [(0, "", 4, 3), (1, "(0,1,4,2,5)", None, 2)]
    patterns = spark.createDataFrame(rows, "n_edges int, code string, vlabel int, support long")
    results.write_patterns(patterns, str(tmp_path / "p"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "p")).collect())
    assert text == "t # 0 * 3\nv 0 4\n\nt # 1 * 2\nv 0 4\nv 1 5\ne 0 1 2\n"
    windows = spark.createDataFrame([(3, 1)], "win int, x int")
    results.write_windows(windows, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).first().name == "WIN003"


def test_mails_of_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "1.").write_bytes(b"Message-ID: <1>\r\nDate: Mon, 14 May 2001 16:39:00 -0700 (PDT)\r\nFrom: x@in.example\r\nTo: y@in.example,\r\n\tz@out.example\r\n\r\nFrom: nobody\r\n")
    (tmp_path / "a" / "b" / "2.").write_text("Message-ID: <2>\n\nTo: not a header")
    (tmp_path / "a" / "3.").write_text("")
    found = {r.msg_id: r for r in mail.parse_mail(mail.read_mails(spark, str(tmp_path / "a"))).collect()}
    assert (found["<1>"].sender, found["<1>"].recipients) == ("x@in.example", ["y@in.example", "z@out.example"])
    assert (found["<2>"].sender, found["<2>"].recipients) == (None, [""])


def test_containing_meets_graphs_by_edges(spark):
    graph = "g int, src int, dst int, sl int, el int, dl int"
    graphs = spark.createDataFrame([(0, 1, 2, 0, 0, 1), (0, 2, 3, 1, 0, 0), (1, 1, 2, 0, 0, 1)], graph)
    code = "(0,1,0,0,1)(1,2,1,0,0)"
    rows = spark.createDataFrame([(code, [1, 2, 3]), (code, [3, 2, 1]), (code, [1, 2, 4])], "code string, v array<int>")
    assert sorted((r.g, tuple(r.v)) for r in match.containing(rows, graphs, "g").collect()) == [(0, (1, 2, 3)), (0, (3, 2, 1))]
    assert match.containing(rows, graphs.limit(0), "g").count() == 0
