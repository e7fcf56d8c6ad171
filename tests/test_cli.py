"""The command line, from sequence files to printed lines."""

import io

import numpy as np
import pytest

from quillmer import cli


def test_commands(spark, tmp_path, capsys, monkeypatch):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("ACGT"), 400))
    other = base[:200] + "".join(rng.choice(list("ACGT"), 200))
    (tmp_path / "a.fa").write_text(f">a first\n{base}\n")
    (tmp_path / "b.fa").write_text(f">b\n{other}\n>b2\n{base[100:300]}\n")
    (tmp_path / "list").write_text(f"{tmp_path / 'a.fa'}\n{tmp_path / 'b.fa'}\n")
    a, b = str(tmp_path / "a.fa"), str(tmp_path / "b.fa")

    def call(*args):
        code = cli.main([str(x) for x in args])
        return code, capsys.readouterr().out.splitlines()

    assert call("sketch", "-k", 11, "-s", 50, "-M", "-o", tmp_path / "both", a, b) == (0, [])
    made = f"{tmp_path / 'both'}.sketches"
    code, lines = call("info", "-t", made)
    assert code == 0 and len(lines) == 3 and lines[1].split("\t")[:2] == ["50", "400"]
    assert any(x == "kmer\t11" for x in call("info", "-H", made)[1]) and call("info", "-c", made)[1] and '"kmer": 11' in "\n".join(call("info", "-d", made)[1])
    code, lines = call("dist", made, a, b)
    assert len(lines) == 4 and lines[0].split("\t")[2] == "0"
    assert call("dist", "-t", "-k", 11, a, a, b)[1][0].startswith("#query")
    assert call("triangle", "-k", 11, "-l", tmp_path / "list")[1][0] == "\t2"
    assert len(call("triangle", "-k", 11, "-E", b)[1]) == 1
    assert len(call("screen", made, b)[1]) == 2
    assert call("within", "-k", 11, "-e", 0.5, a, b)[1]
    assert call("find", "-k", 12, "-W", 20, "-s", 500, "-B", 1, a, b)[1] == call("find", "-k", 12, "-L", 20, "-s", 500, "-b", 1, a, b)[1] != []
    assert call("find", "-self", "-k", 12, "-W", 20, "-s", 500, a, a) == (0, [])
    grid = [x.split("\t") for x in call("bounds", "-k", 15)[1]]
    rows = [x for x in grid if len(x) == 9 and x[0].isdigit()]
    assert len(rows) == 18 and [x[0] for x in rows[:2]] == ["100", "500"] and len([x for x in grid if x[0] == "Sketch"]) == 2
    assert call("screen", "-w", "-p", 2, made, b)[1]
    assert call("dist", "-C", "-k", 11, a, a)[1][0].split("\t")[0] == f"{a}:a first"
    assert len(call("triangle", "-C", "-k", 11, "-E", b)[1]) == 1
    assert call("sketch", "-z", "ACGT", "-k", 11, "-o", tmp_path / "z", a)[0] == 0 and "canonical\tFalse" in "\n".join(call("info", "-H", f"{tmp_path / 'z'}.sketches")[1])
    (tmp_path / "collections").write_text(f"{made}\n{made}\n")
    assert call("paste", "-l", tmp_path / "listed", tmp_path / "collections") == (0, []) and len(call("info", "-t", f"{tmp_path / 'listed'}.sketches")[1]) == 5
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(f">in put\n{base}\n".encode())))
    assert call("sketch", "-k", 11, "-o", tmp_path / "piped", "-") == (0, []) and call("info", "-t", f"{tmp_path / 'piped'}.sketches")[1][1].split("\t")[2:] == ["in", "in put"]
    assert call("paste", tmp_path / "out", made, made) == (0, []) and len(call("info", "-t", f"{tmp_path / 'out'}.sketches")[1]) == 5
    assert call("dist", "-k", 9, made, a)[0] == 1
    with pytest.raises(SystemExit):
        cli.main(["nonsense"])
