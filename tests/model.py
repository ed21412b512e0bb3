"""The transformation operators on plain rows, as a second opinion: rows are dicts, a frame is a list of rows."""


def compare(a, op, b):
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    if a is None or b is None:
        return False
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def filter_rows(frames, column, op, value):
    return [[r for r in f if compare(r.get(column), op, value)] for f in frames]


def deduplicate(frames, keys):
    out = []
    for f in frames:
        seen = {}
        for r in f:
            seen.setdefault(tuple(r.get(k) for k in keys), r)
        out.append(list(seen.values()))
    return out


def join(frames, on):
    rows = {}
    columns = list(on)
    for f in frames:
        for r in f:
            columns += [c for c in r if c not in columns]
    for f in frames:
        for r in f:
            row = rows.setdefault(tuple(r.get(k) for k in on), dict.fromkeys(columns))
            row.update({c: v for c, v in r.items() if v is not None})
    return list(rows.values())


def aggregate(frames, keys, column, how):
    out = []
    for f in frames:
        groups = {}
        for r in f:
            groups.setdefault(tuple(r.get(k) for k in keys), []).append(r.get(column))
        for key, values in groups.items():
            numbers = [v for v in values if v is not None]
            made = {"count": lambda: len(values), "sum": lambda: sum(numbers), "min": lambda: min(numbers), "max": lambda: max(numbers)}
            out.append({**dict(zip(keys, key)), column: made[how]() if numbers or how == "count" else None})
    return out
