"""What is unpacked is handed on in small parts: a task holds few rows."""

import io
import zipfile

import pyarrow as pa

from ledgerline.sources import archives as A


class Files:
    """Stands for a table: gives what would run in a task."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_parts_are_small():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i in range(3000):
            z.writestr(f"m{i}", b"x" * (1 if i % 100 else 1 << 20))
    rows = pa.record_batch([["a.zip", None, "b"], [buffer.getvalue(), None, None]], ["path", "content"])
    parts = list(A.unpacked(Files())(iter([rows])))
    assert max(len(p) for p in parts) <= 1000 and max(p.nbytes for p in parts) < 6 << 20
    paths = [x for p in parts for x in p["path"].to_pylist()]
    assert paths == [*(f"a.zip/m{i}" for i in range(3000)), None, "b"]
    assert [len(x) for p in parts for x in p["content"].to_pylist() if x is not None] == [1 if i % 100 else 1 << 20 for i in range(3000)]
