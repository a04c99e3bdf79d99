"""The command line on a small folder."""

from lorekeep.__main__ import main
from tests.test_sources import STANDARD, standard_rows, write_csv


def test_clean_import_and_list(spark, tmp_path, capsys, monkeypatch):
    import lorekeep.__main__ as cli

    monkeypatch.setattr(cli, "get_session", lambda app: spark)
    (tmp_path / "csv").mkdir()
    rows = standard_rows(6, "alpha")
    write_csv(tmp_path / "csv" / "a.csv", STANDARD, [*rows, rows[0]])
    root = ["--root", str(tmp_path / "data")]
    main([*root, "clean", "--folder", str(tmp_path / "csv"), "--out", str(tmp_path / "csv_clean")])
    assert "|a.csv |7    |0       |1         |6   |14.3     |" in capsys.readouterr().out
    main([*root, "import-chat", "--persona", "me", "--base", str(tmp_path)])
    assert "documents=6, written=6" in capsys.readouterr().out
    main([*root, "collections"])
    assert "|l2    |6 " in capsys.readouterr().out
    main([*root, "personas"])
    assert "|me " in capsys.readouterr().out
