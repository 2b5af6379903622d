import struct

from quarry import integrity
from quarry.sources import zim
from tests.test_zim import ROWS, build


def first(spark, path):
    return {r["check"]: (r.place, r.n) for r in integrity.report(integrity.problems(spark, [str(path)], integrity.FULL, step=2)).collect()}


def test_each_check_finds_its_fault(spark, tmp_path):
    f = tmp_path / "a.zim"
    rows = [*ROWS, ("X", "listing/titleOrdered/v1", "", struct.pack("<4I", 0, 1, 2, 3))]
    good = build(rows, 5)
    f.write_bytes(good)
    assert first(spark, f) == {}
    h = zim.parse_header(good, len(good))
    place = lambda at, k: struct.unpack_from("<Q", good, at + 8 * k)[0]

    def broken(at, data):
        x = bytearray(good)
        x[at : at + len(data)] = data
        f.write_bytes(x)
        return first(spark, f)

    swapped = broken(h.path_ptr, struct.pack("<QQ", place(h.path_ptr, 1), place(h.path_ptr, 0)))
    assert swapped["entry_order"] == (1, 1) and "checksum" in swapped
    assert broken(h.path_ptr + 16, struct.pack("<Q", 1 << 40))["entry_pointers"] == (2, 1)
    assert broken(h.cluster_ptr, struct.pack("<Q", 1 << 40))["cluster_pointers"] == (0, 1)
    assert broken(place(h.path_ptr, 1), struct.pack("<H", 7))["mime_types"] == (1, 1)
    assert broken(place(h.cluster_ptr, 1), b"\x02")["clusters"] == (1, 1)
    f.write_bytes(build([*ROWS, ("X", "listing/titleOrdered/v1", "", struct.pack("<3I", 0, 3, 1))], 5))
    assert first(spark, f) == {"title_order": (2, 1)}
