import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import common
from marlstone.llm.words import CHUNK_BYTES, Words, rolled


def fake(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(fake(master))
        assert common.shared_dir(fake(master, "hdfs://a/b/")) == "hdfs://a/b"
    assert common.shared_dir(fake("local[4]")) and common.shared_dir(fake("local"))


def test_cleanup(spark):
    kept = common.stored(spark.range(10), "cleanup-test")
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and kept.count() == 10
    assert common.cleanup(spark) >= 1 and not os.path.exists(folder) and common.cleanup(spark) == 0


def test_names_of_words():
    texts = [None, "", " a  b\ta ", "A b", "é\u00a0é x", "a" * 300, "b a", "\n\n"]
    v, bounds = Words(fold=False).read(pa.array(texts))
    split = [(t or "").encode().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in split]
    names = {}
    for word, name in zip((w for s in split for w in s), v.tolist(), strict=True):
        assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)
    folded, _ = Words(fold=True).read(pa.array(["A b É", "a B É"]))
    assert folded[:3].tolist() == folded[3:].tolist()


def test_chunks_and_offsets_do_not_matter():
    long = " ".join(f"w{i}" for i in range(400_000)) + " " + "x" * (2 * CHUNK_BYTES) + " end"
    whole, _ = Words(fold=False).read(pa.array([long]))
    parts, bounds = Words(fold=False).read(pa.array(["other", *long.split(" "), "more"]).slice(1, 400_002))
    assert whole.tolist() == parts.tolist() and len(bounds) == 400_003
    assert rolled(whole, 3)[5] == rolled(whole[5:8], 3)[0] and len(rolled(whole[:2], 3)) == 0
