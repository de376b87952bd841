"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import pytest

from seqsieve.plans.catalogue import ORACLES, QUERIES
from tests.oracle import expected, same

SMALL = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")
#: Fits whose result on so few rows is not clear-cut; the check at sf0.01 covers them.
LARGER = {n for n in ORACLES if n.startswith("m") and n[1].isdigit()} | {"c2_stratified", "c3_local_mutants", "k16_corpus", "f5_dimers", "f11_kmer_deltas", "b10_replicas"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGER))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL).toPandas(), expected(ORACLES[name], SMALL))


def test_registry_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr
