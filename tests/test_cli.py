import os

import pytest

from tarnflow.__main__ import main
from tarnflow.plans import more

SF = "/root/testdata/sf0.001"


def test_lists_and_sql(capsys):
    assert main(["list"]) == 0
    assert capsys.readouterr().out.split() == sorted(more.QUERIES)
    assert main(["sql", "cn_stats"]) == 0 and "SELECT" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "x"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark, tmp_path, capsys):
    assert main(["run", "soil_loss_bands", SF, "--out", f"{tmp_path}/r"]) == 0
    assert spark.read.parquet(f"{tmp_path}/r").columns == ["p_partkey", "severity"]
    assert main(["run", "soil_loss_bands", SF, "--rows", "2"]) == 0 and "severity" in capsys.readouterr().out
