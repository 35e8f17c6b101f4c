import pytest

from lodestone import options as O
from lodestone.errors import InvalidArguments, SystemFailure


def test_coercion():
    assert [O.to_int(v) for v in ("123hoge", "-100.5", 7, 3.9, None, [1], {"a": 1}, "x")] == [123, -100, 7, 3, 0, 0, 0, 0]
    assert [O.to_float(v) for v in ("-100.5", "1e3x", ".5", None, [1])] == [-100.5, 1000.0, 0.5, 0.0, 0.0]
    assert [O.to_bool(v) for v in (0, 1, 0.0, "true", "on", "0", "2", "off", [], {}, None, b"", b"a")] == [False, True, True, True, True, False, True, False, True, True, False, False, True]
    assert O.to_text(None) == "(null)" and O.to_text(b"\x01a") == "\\x01\\x61" and O.to_text({"b": [1, "x"], "a": None}) == '{"a": (null), "b": [1, "x"]}'


def test_sparse_list():
    x = O.SparseList()
    x[3] = 1
    assert len(x) == 4 and x[0] is None
    assert x[5] is None and len(x) == 6


def test_yaml(tmp_path):
    text = "---\nnamespace: test # comment\ndriver:\n  name: sim\n  color_weight: 0.2\n  shard:\n    - 0-7\n    - '8'\ndatabase:\n  driver: sqlite3\nlist:\n- a: 1\n  b: 2\n- c\n"
    p = tmp_path / "c.yaml"
    p.write_text(text)
    c = O.load(p)
    assert c == {"namespace": "test", "driver": {"name": "sim", "color_weight": "0.2", "shard": ["0-7", "8"]}, "database": {"driver": "sqlite3"}, "list": [{"a": "1", "b": "2"}, "c"]}
    assert O.get(c, "driver.name") == "sim" and O.get(c, "driver.no.such", 5) == 5
    with pytest.raises(SystemFailure):
        O.load(tmp_path / "none.yaml")
    with pytest.raises(InvalidArguments):
        O.parse_yaml("just text")
