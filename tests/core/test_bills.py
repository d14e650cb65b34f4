"""More files make more bills of material, not larger ones."""

import glob
import json
import os

from ledgerline import plans
from ledgerline.plans import license_queries as Q
from ledgerline.plans import more_queries as M

from ..conftest import SMALL


def test_bills_are_bounded(spark, monkeypatch):
    paths, write = [], Q.R.write_spdx_rdf
    monkeypatch.setattr(Q.R, "write_spdx_rdf", lambda files, path: paths.append(path) or write(files, path))
    monkeypatch.setattr(Q, "_FILES_OF_A_BILL", 10, raising=False)
    files = spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").count()
    assert plans.QUERIES["spdx_rdf_round_trip"](spark, SMALL).count() == files
    bills = [f for f in os.listdir(paths[0]) if f.startswith("part-")]
    assert len(bills) > files / 20 > 8


def test_cyclonedx_documents_are_bounded(spark, monkeypatch):
    """Every document is whole, and none holds all files."""
    paths, fresh = [], M._fresh
    monkeypatch.setattr(M, "_fresh", lambda s, name: paths.append(fresh(s, name)) or paths[-1])
    monkeypatch.setattr(M, "_FILES_OF_A_BILL", 20, raising=False)
    names = {f"f{r.doc_id}" for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").collect()}
    assert {r.name for r in plans.QUERIES["cyclonedx_round_trip"](spark, SMALL).collect()} == names
    bills = [json.loads(b"".join(open(f, "rb").read() for f in glob.glob(f"{d}/part-*"))) for d in glob.glob(f"{paths[0]}/bill=*")]
    assert len(bills) >= len(names) / 20 and len({b["serialNumber"] for b in bills}) == len(bills)
    assert all(b["components"][0]["type"] == "application" for b in bills)
    assert max(len(b["components"]) for b in bills) < 60 and sum(len(b["components"]) - 1 for b in bills) == len(names)
