"""Kinds of rows and regions on random sheets against a plain state machine."""

import random

from celldag.operators import rows

CELLS = "sheet string, block int, row int, col int, text string, num double, bold boolean, fill string, last_col int, is_formula boolean"


def plain_kinds(cells, forced=(), left_out=()):
    """{row: kind} of one block, row after row with its state."""
    cells = [c for c in cells if c[2] not in left_out]
    low, high = min(c[3] for c in cells), max(c[8] or c[3] for c in cells)
    out, open_, cols = {}, False, set()
    for r in range(min(c[2] for c in cells), max(c[2] for c in cells) + 1):
        row = sorted((c for c in cells if c[2] == r), key=lambda c: c[3])
        if not row:
            open_ = False
            continue
        text = lambda c: c[4] is not None
        width = lambda c: (c[8] or c[3]) - c[3] + 1
        fills = [c[7] for c in row if c[6] and c[7] and text(c)]
        by_col = {c[3]: c for c in row}
        pairs = 0
        for c in row:
            beside = by_col.get(c[3] + 1) or by_col.get(c[3] + 2)
            pairs += bool(text(c) and beside and not (text(beside) and width(beside) > 2))
        if r in forced or (len(fills) >= 2 and len(set(fills)) == 1 and not (len(row) == 1)):
            kind = "HEADER"
        elif len(row) == 1 and row[0][8] and text(row[0]) and width(row[0]) >= max(3, high - low + 1 - 3):
            kind = "NOTE"
        elif open_ and len(set(by_col) & cols) >= max(2, int(len(cols) * 0.6)):
            kind = "DATA"
        elif pairs >= 2:
            kind = "KV"
        elif len(row) <= 3 and text(row[0]) and (any(not text(c) or c[9] for c in row[1:]) if row[1:] else not row[0][8]):
            kind = "SUMMARY"
        else:
            kind = "KV" if pairs else "NOTE" if all(map(text, row)) else "DATA"
        if kind == "HEADER":
            cols = (cols if open_ else set()) | set(by_col)
            open_ = True
        elif kind != "DATA":
            open_ = False
        out[r] = kind
    return out


def plain_regions(kinds):
    out, last = [], None
    for r in sorted(kinds):
        k = kinds[r]
        joins = last is not None and r == last[0] + 1 and (k == last[1] or (last[1], k) == ("HEADER", "DATA"))
        if joins:
            out[-1][2], out[-1][3] = r, out[-1][3] + (k == "HEADER")
        else:
            out.append([{"HEADER": "TABLE", "DATA": "NOTE"}.get(k, k), r, r, int(k == "HEADER")])
        last = (r, k)
    return [(i, *x) for i, x in enumerate(out)]


def random_sheet(rng, name, block):
    out = []
    for r in range(1, rng.randint(8, 30)):
        shape = rng.choice(["head", "head", "data", "data", "data", "data", "kv", "sum", "note", "blank", "any"])
        at = sorted(rng.sample(range(1, 8), rng.randint(1, 6)))
        if shape == "head":
            out += [(name, block, r, c, f"h{c}", None, True, rng.choice(["A", "A", "A", "B"]), None, False) for c in at]
        elif shape == "data":
            out += [(name, block, r, c, *(("t", None) if rng.random() < 0.3 else (None, 1.0)), False, None, None, rng.random() < 0.1) for c in at]
        elif shape == "kv":
            out += [(name, block, r, c, *(("k", None) if c % 2 else (None, 2.0)), False, None, None, False) for c in range(1, 2 * rng.randint(1, 3) + 1)]
        elif shape == "sum":
            out += [(name, block, r, 1, "sum", None, False, None, rng.choice([None, None, 2]), False)] + ([(name, block, r, 3, None, 9.0, False, None, None, True)] if rng.random() < 0.7 else [])
        elif shape == "note":
            out.append((name, block, r, 1, "a long note", None, False, None, rng.choice([3, 5, 7]), False))
        elif shape == "any":
            out += [(name, block, r, c, rng.choice(["x", None]), None, rng.random() < 0.5, rng.choice([None, "A"]), rng.choice([None, c + 3]), False) for c in at]
    return [c if c[4] is not None or c[5] is not None else (*c[:5], 3.0, *c[6:]) for c in out]


def test_random_sheets_equal_a_plain_state_machine(spark):
    rng = random.Random(6)
    sheets = {(f"s{i}", b): random_sheet(rng, f"s{i}", b) for i in range(120) for b in (0, 1)}
    sheets = {k: v for k, v in sheets.items() if v}
    forced, left_out = {("s1", 5), ("s2", 4), ("s3", 9)}, {("s4", 3), ("s5", 6)}
    df = spark.createDataFrame([c for s in sheets.values() for c in s], CELLS)
    mark = lambda rows_: spark.createDataFrame(sorted(rows_), "sheet string, row int")
    kinds = rows.row_kinds(df, mark(forced), mark(left_out)).persist()
    got = {}
    for r in kinds.collect():
        got.setdefault((r["sheet"], r["block"]), {})[r["row"]] = r["kind"]
    wanted = {k: plain_kinds(v, {r for s, r in forced if s == k[0]}, {r for s, r in left_out if s == k[0]}) for k, v in sheets.items()}
    assert got == wanted
    assert {k for w in wanted.values() for k in w.values()} == {"HEADER", "DATA", "KV", "SUMMARY", "NOTE"}
    found = {}
    for r in rows.row_regions(kinds).orderBy("region").collect():
        found.setdefault((r["sheet"], r["block"]), []).append((r["region"], r["region_type"], r["first_row"], r["last_row"], r["header_rows"]))
    assert found == {k: plain_regions(w) for k, w in wanted.items()}
