"""The shared folder is the one the session names."""

import os
import subprocess
import sys

from corpuswarden.session import Stages, fresh_path, materialize, shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_named_folder_is_used(tmp_path):
    code = (
        "from corpuswarden.session import get_session, fresh_path, materialize\n"
        f"s = get_session('t', 'local[1]', **{{'spark.checkpoint.dir': '{tmp_path}'}})\n"
        "df, n = materialize(s.range(5), 'x')\n"
        "print('RESULT', fresh_path(s, 'y').startswith(s.conf.get('spark.checkpoint.dir')), n, df.count())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "RESULT True 5 5" in out.stdout, out.stderr[-2000:]
    assert any(name.startswith("x-") for name in os.listdir(tmp_path))


def test_stages_read_back_together(spark):
    stages = Stages(spark, "rounds")
    assert stages.add(spark.range(3))[1] == 3
    assert stages.add(spark.range(0))[1] == 0
    assert stages.add(spark.range(3, 5))[1] == 2
    assert sorted(r.id for r in stages.all().collect()) == [0, 1, 2, 3, 4]
    assert shared_folder(spark) == shared_folder(spark)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    assert materialize(spark.range(2).where("id > 5"), "none")[1] == 0
