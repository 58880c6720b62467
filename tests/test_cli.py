import pytest

from marlstone.__main__ import main


def test_commands(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "in.csv").write_text("1,a\n2,b\n0,\n")
    (tmp_path / "s.csv").write_text("AdvEngineID,int16\nSearchPhrase,string\n")
    main(["csv-to-store", p("in.csv"), p("s.csv"), p("t")])
    main(["store-to-csv", p("t"), p("csv"), "--columns", "SearchPhrase"])
    assert sorted(r.value for r in spark.read.text(p("csv")).collect()) == ['""', '"a"', '"b"']
    main(["export-column", p("t"), "AdvEngineID", p("one")])
    assert spark.read.text(p("one")).count() == 3
    main(["store-to-column-file", p("t"), p("t.col"), "--rows", "2"])
    main(["column-file-to-store", p("t.col"), p("t2")])
    assert sorted(map(tuple, spark.read.parquet(p("t2")).collect())) == [(0, ""), (1, "a"), (2, "b")]
    main(["run-query", "1", p("t")])
    assert "2" in capsys.readouterr().out
    main(["run-query", "5", p("t"), "--out", p("q5")])
    assert [r.value for r in spark.read.text(p("q5")).collect()] == ['"3"']
    with pytest.raises(ValueError):
        main(["run-query", "99", p("t")])
