import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_entry_and_names(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    if DATA.exists():
        assert entry.entry(spark).count() > 0


def test_nothing_imports_the_llm_package():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_the_shared_folder_is_the_clusters_or_our_own(spark):
    from millrace.session import shared_dir

    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

    class Bare:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getConf = staticmethod(lambda: {})

    own = shared_dir(Bare)
    assert own.startswith("file:///") and shared_dir(Bare) == own

    class Cluster(Bare):
        class sparkContext:
            getConf = staticmethod(lambda: {"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
