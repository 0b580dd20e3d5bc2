from types import SimpleNamespace

import pytest

from ledgerlake.plans.scratch import new_folder, scratch_root
from ledgerlake.sources.files import list_files, locate


class Session(SimpleNamespace):
    __hash__ = object.__hash__


def session(**conf):
    names = {"dir": "spark.checkpoint.dir", "master": "spark.master"}
    values = {names[k]: v for k, v in conf.items()}
    return Session(conf=SimpleNamespace(get=lambda name, default=None: values.get(name, default)))


def test_the_folder_the_cluster_names():
    assert scratch_root(session(dir="hdfs://shared/checkpoints/", master="yarn")) == "hdfs://shared/checkpoints"
    assert scratch_root(session(dir="/shared", master="local[8]")) == "/shared"
    folder = new_folder(session(dir="/shared", master="yarn"), "ordered")
    assert folder.startswith("/shared/ordered-") and folder != new_folder(session(dir="/shared"), "ordered")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session(master="yarn"))


def test_a_local_folder_for_a_local_master():
    local = session(master="local[2]")
    assert scratch_root(local) == scratch_root(local)


def test_paths_and_uris(tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    (tmp_path / "c.txt").write_text("yy")
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert [(u.rsplit("/", 1)[1], n) for u, n in list_files(uri, "*.txt")] == [("a b.txt", 1), ("c.txt", 2)]
        assert locate(uri)[1] == str(tmp_path)
    assert [n for _, n in list_files(f"{tmp_path}/c*", "*.txt")] == [2]
    assert list_files(f"{tmp_path}/c.txt", "ignored") == [(f"{tmp_path}/c.txt", 2)]
