import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from guestlens.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="gl-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def land_lines(tmp_path):
    """Write JSON lines to a fresh folder and return its path."""
    def write(lines, name="pages"):
        d = tmp_path / name
        d.mkdir()
        (d / "part-0.json").write_text("\n".join(lines) + "\n")
        return str(d)
    return write
