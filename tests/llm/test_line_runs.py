import random

import pytest
from pyspark.sql import functions as F

from tablesync.llm import line_runs


def brute(rows, least):
    """Deleted runs of rows with distinct ids."""
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n") if text else []
        gone = set()
        for at in range(len(lines) - least + 1):
            key = tuple(lines[at : at + least])
            if key in seen:
                gone.update(range(at, at + least))
            seen[key] = True
        at = 0
        while at < len(lines):
            if at in gone:
                end = at
                while end in gone:
                    end += 1
                out.append((i, at, end - at))
                at = end
            at += 1
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_against_brute_force(docs, least):
    rng = random.Random(least)
    rows = []
    for i in range(80):
        lines = rng.choices(["a", "b", "c", "", f"only {i}", "d"], k=rng.randint(0, 25))
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, "x\n" * 40), (202, "x\n" * 30), (None, rows[5][1]), (204, None)]
    assert got(line_runs.line_dedup(docs(rows), least=least)) == brute(rows, least)


def brute_by_words(rows, least, words):
    """Deleted runs if fewer lines count too once they hold ``words`` words."""
    seen, out = {}, []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        lines = (text or "").split("\n") if text else []
        gone = set()
        for n in range(1, least + 1):
            for at in range(len(lines) - n + 1):
                key = tuple(lines[at : at + n])
                if n == least or sum(len(x.split()) for x in key) >= words:
                    if key in seen:
                        gone.update(range(at, at + n))
                    seen[key] = True
        starts = [a for a in sorted(gone) if a - 1 not in gone]
        out += [(i, a, next(k for k in range(a, len(lines) + 1) if k not in gone) - a) for a in starts]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 3, 4])
def test_short_runs_of_many_words(docs, least):
    rng = random.Random(least)
    rows = []
    for i in range(80):
        lines = rng.choices(["a", "b", "c d e", "", f"only {i}", "f  g h i j", "\tk l", "m n o p q r s"], k=rng.randint(0, 12))
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (None, rows[5][1]), (204, None)]
    assert got(line_runs.line_dedup(docs(rows), least=least, words=6)) == brute_by_words(rows, least, 6)


def test_a_long_paragraph_on_one_line(docs):
    paragraph = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{paragraph}\nb"), (2, f"c\n{paragraph}"), (3, paragraph), (4, "a")]
    assert got(line_runs.line_dedup(docs(rows), words=50)) == [(2, 1, 1), (3, 0, 1)]
    assert got(line_runs.line_dedup(docs(rows))) == []


def test_touching_runs_join_and_lines_go(docs):
    rows = [(1, "a\nb\nc\nd\ne\nf"), (2, "q\na\nb\nc\nd\ne\nf\nz")]
    assert got(line_runs.line_dedup(docs(rows))) == [(2, 1, 6)]
    runs = F.array(F.struct(F.lit(1).alias("first_line"), F.lit(6).alias("n_lines")))
    assert docs(rows).where("doc_id = 2").select(line_runs.kept_lines(F.col("text"), runs)).first()[0] == "q\nz"


def test_odd_rows(docs, odd):
    same = "l1\nl2\nl3"
    rows = [*odd, (50, same), (50, same), (49, same)]
    assert got(line_runs.line_dedup(docs(rows))) == [(50, 0, 3), (50, 0, 3)]
    assert got(line_runs.line_dedup(docs([]))) == []


def test_only_dataframe_functions(docs):
    plan = line_runs.line_dedup(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
