import json

import pytest
from ravelin import cli


def test_programs(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text("".join(json.dumps({"user_id": f"u{i % 3}", "business_id": f"b{i % 2}", "date": "2018-01-01", "stars": i % 5}) + "\n" for i in range(9)))
    (tmp_path / "b.json").write_text('{"business_id": "b0", "city": "A"}\n{"business_id": "b1", "city": "B"}\n')
    (tmp_path / "p.csv").write_text("user_id,business_id\n" + "".join(f"u{i % 3},b{i % 4}\n" for i in range(12)))
    (tmp_path / "t.csv").write_text("user_id,business_id,stars\nu0,b0,3\nu0,b1,4\nu1,b0,5\nu1,b1,2\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["summary", at("r.json"), at("o1")])
    assert json.loads((tmp_path / "o1").read_text())["n_review"] == 9
    cli.main(["partitions", at("r.json"), at("o2"), "2"])
    assert json.loads((tmp_path / "o2").read_text())["customized"]["n_partition"] == 2
    cli.main(["cities", at("r.json"), at("b.json"), at("o3"), at("o4")])
    assert spark.read.csv(at("o3"), header=True).count() == 2
    cli.main(["itemsets", at("p.csv"), at("o5"), "--support", "2"])
    assert (tmp_path / "o5").read_text().startswith("Candidates:")
    cli.main(["similar", at("p.csv"), at("o6")])
    cli.main(["predict", at("t.csv"), at("t.csv"), at("o7"), "--case", "3"])
    assert "RMSE: 0.0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["predict", at("t.csv")])
