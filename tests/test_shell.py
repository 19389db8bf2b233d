from orrery.shell import FIRST, MORE, complete, run


def test_statement_ends():
    assert complete("SELECT 1;") and complete("SELECT ';' FROM t;")
    assert not complete("SELECT ';") and not complete("SELECT 'it\\';") and not complete('SELECT ";" ')


def test_session(db):
    out = []
    lines = ["CREATE TABLE t (a INTEGER,", " b VARCHAR(9));", "INSERT INTO t VALUES (1, 'x;y');", ".tables", ".schema t", ".d nope", "SELECT * FROM t;", "SELECT z FROM t;", ".what", ".help", ".quit", "SELECT 1;"]
    run(db, lines, out.append)
    assert out[0] == "OK, 0 rows affected" and out[1] == "OK, 1 row affected" and out[2] == "t" and out[3] == "a INTEGER\nb VARCHAR(9)" and out[4] == "no table nope"
    assert "| 1 | x;y |" in out[5] and out[5].endswith("1 row") and out[6].startswith("Error: invalid argument") and out[7] == "unknown command .what" and len(out) == 9


def test_prompts(db):
    asked = []
    run(db, ["CREATE TABLE t (a INTEGER,", " b INTEGER);", ".tables"], lambda text: None, asked.append)
    assert asked == [FIRST, MORE, FIRST, FIRST]
