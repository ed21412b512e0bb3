"""The concept mapper against a plain version on random fields, similar names against all pairs, dictionary sheets."""

import difflib
import random
import re
import unicodedata

from celldag.functions.units import Units
from celldag.operators import concepts

UNITS = Units.parse()


def norm(t):
    return re.sub(r"[\s()\[\]{}.\-_/·:#]+", "", unicodedata.normalize("NFKC", t or "").lower().strip())


def unit_table(spark):
    return spark.createDataFrame([(s, d) for s in UNITS.spellings() for d in UNITS.dimensions_of(s)], "unit string, dimension string")


def test_similar_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé온도") for _ in range(rng.randint(1, 9)))
    a, b = {word() for _ in range(150)} | {"", "aaaa", "aaaaaaaa"}, {word() for _ in range(120)} | {"aaa", "x"}
    got = {(r["a"], r["b"]): r["ratio"] for r in concepts.similar(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string")).collect()}
    all_pairs = {(x, y): difflib.SequenceMatcher(None, x, y).ratio() for x in a for y in b if x and y}
    assert got == {p: r for p, r in all_pairs.items() if r >= concepts.LEAST_RATIO} and len(got) > 100


CONCEPTS = [("temp", 0, "온도", "temperature", [], []), ("core", 1, "core temperature", "temperature", ["meat", "core"], ["input", "measured"]), ("time", 2, "종료", "time_of_day", [], []), ("weight", 3, "weight", "mass", [], ["result"]), ("lot", 4, "LOT No.", None, [], []), ("end", 5, "종료온도", "temperature", ["reactor"], [])]
NAMES = [("temp", "Temp"), ("temp", "temperature"), ("core", "core temp"), ("core", "심부온도"), ("time", "end time"), ("weight", "mass"), ("weight", "wt"), ("lot", "lot number"), ("lot", "batch"), ("end", "end temp")] + [(c[0], c[2]) for c in CONCEPTS]


def plain(f, listed, vocabulary=CONCEPTS, known=NAMES):
    """(concept, confidence, decision) of a field by loops."""
    _, doc, sheet, label, path, unit, value, is_formula, role = f

    def judge(label, context):
        out = []
        for c, _, _, dim, words, roles in vocabulary:
            names = [n for k, n in known if k == c]
            ratios = [difflib.SequenceMatcher(None, norm(label), norm(n)).ratio() for n in names]
            base = 1.0 if label in names else 0.95 if norm(label) and norm(label) in map(norm, names) else max(ratios) * 0.8 if max(ratios) >= 0.55 else None
            if base is None:
                continue
            inside = lambda u: dim in UNITS.dimensions_of(u)
            m = re.match(r"^\s*[-+]?\d+(?:\.\d+)?\s*(\S.*?)\s*$", value[1]) if value[1] is not None else None
            if unit and dim:
                if not inside(unit):
                    continue
                base = min(1.0, base + 0.05)
            elif unit is None and dim and dim != "time_of_day" and value[1] is not None and not is_formula:
                if m and UNITS.dimensions_of(m.group(1)):
                    if not inside(m.group(1)):
                        continue
                    base = min(1.0, base + 0.05)
                elif not re.match(r"^[\d.\-+~≥≤<> ]+$", value[1]):
                    continue
            if words:
                base = min(1.0, base + 0.05) if any(w in " ".join([doc, sheet, *context]) for w in words) else base - 0.25
            if roles and role is not None and role not in ("unknown", *roles):
                base -= 0.1
            if base > 0.3:
                out.append((round(base, 4), c))
        out.sort(key=lambda x: -x[0])
        auto = bool(out) and out[0][0] >= 0.85 and not (len(out) > 1 and out[1][0] >= out[0][0] - 0.05)
        return (out[0][1], out[0][0], auto) if out else (None, 0.0, False)

    hit = listed.get((doc, norm(label)))
    if hit:
        dim = next(c[3] for c in vocabulary if c[0] == hit)
        if not dim or not unit or dim in UNITS.dimensions_of(unit):
            return hit, 0.97, "auto"
    c, s, auto = judge(label, path[:-1])
    if not auto:
        for p in reversed(path[:-1]):
            pc, ps, pa = judge(p, path[:-2])
            if pa and round(ps * 0.95, 4) >= 0.85:
                return pc, round(ps * 0.95, 4), "auto"
    return c, s, "auto" if auto else "pending"


def test_decisions_equal_a_plain_version(spark):
    rng = random.Random(9)
    labels = ["온도", "Temp", "temp.", "tempe", "core temp", "Core-Temp", "심부온도", "종료", "종료온도", "wt", "weigth", "PV", "lot", "LOT No", "batch", "zzz", "", "Temp / end"]
    rows = []
    for i in range(400):
        path = [rng.choice(labels) for _ in range(rng.randint(0, 2))]
        label = rng.choice(labels)
        value = rng.choice([(1.0, None), (None, "180 ℃"), (None, "12 kg"), (None, "ok"), (None, "≥ 12"), (None, None), (None, "3 zorks")])
        rows.append((i, rng.choice(["d1", "meat.xlsx", "reactor"]), rng.choice(["s", "core"]), label, [*path, label], rng.choice([None, None, "℃", "kg", "°F", "zorks", ""]), value, rng.random() < 0.2, rng.choice([None, "unknown", "input", "result"])))
    fields = spark.createDataFrame(rows, "field int, document string, sheet string, label string, path array<string>, unit string, value struct<num:double,text:string>, is_formula boolean, style_role string")
    listed = {("d1", "zzz"): "weight", ("reactor", "pv"): "temp", ("d1", "온도"): "lot"}
    dictionary = spark.createDataFrame([(d, t, c) for (d, t), c in listed.items()], "document string, term string, concept string")
    found = concepts.decide(fields, spark.createDataFrame(CONCEPTS, "concept string, ord int, name string, dimension string, keywords array<string>, roles array<string>"), spark.createDataFrame(NAMES, "concept string, name string"), unit_table(spark), dictionary)
    got = {r["field"]: (r["concept"], r["confidence"], r["decision"]) for r in found.collect()}
    wanted = {r[0]: plain(r, listed) for r in rows}
    assert got == wanted
    assert len({w[2] for w in wanted.values()}) == 2 and sum(r["via"] is not None for r in found.collect()) > 3


def test_dictionary_sheets(spark):
    cells = [
        ("d", "Tag_Dictionary", 2, 1, "Tag"), ("d", "Tag_Dictionary", 2, 2, "Meaning"), ("d", "Tag_Dictionary", 2, 3, "note"), ("d", "Tag_Dictionary", 1, 1, "only one text"),
        ("d", "Tag_Dictionary", 3, 1, "TT-1 / T1"), ("d", "Tag_Dictionary", 3, 2, "온도(℃)"), ("d", "Tag_Dictionary", 4, 1, "W-9"), ("d", "Tag_Dictionary", 4, 2, "-"), ("d", "Tag_Dictionary", 5, 1, " T1 "), ("d", "Tag_Dictionary", 5, 2, "mass"),
        ("d", "data", 1, 1, "label"), ("d", "data", 1, 2, "value"), ("d", "x", 1, 1, "용어"), ("d", "x", 1, 2, "단위"), ("d", "x", 1, 3, "의미"), ("d", "x", 2, 1, "Q"), ("d", "x", 2, 2, "kg"), ("d", "x", 2, 3, "WT."), ("d", "x", 3, 1, None),
    ]
    df = spark.createDataFrame(cells, "document string, sheet string, row int, col int, text string")
    assert {(r["sheet"], r["header_row"]) for r in concepts.dictionary_sheets(df).collect()} == {("Tag_Dictionary", 2), ("x", 1)}
    entries = concepts.dictionary_entries(df)
    assert {(r["sheet"], r["row"]): (r["terms"], r["unit"]) for r in entries.collect()} == {("Tag_Dictionary", 3): (["TT-1", "T1", "온도(℃)"], None), ("Tag_Dictionary", 4): (["W-9"], None), ("Tag_Dictionary", 5): (["T1", "mass"], None), ("x", 2): (["Q", "WT."], "kg")}
    names = spark.createDataFrame(NAMES, "concept string, name string")
    vocabulary = spark.createDataFrame([c[:2] for c in CONCEPTS], "concept string, ord int")
    got = {r["term"]: r["concept"] for r in concepts.dictionary_terms(entries, names, vocabulary).collect()}
    assert got == {"tt1": "temp", "t1": "temp", norm("온도(℃)"): "temp", "mass": "weight", "q": "weight", "wt": "weight"}


def test_many_names_are_not_sent_to_all_tasks(spark):
    n = concepts.MOST_SENT + 1
    names = spark.range(n).selectExpr("concat('c', id) as concept", "concat('Name ', id) as name")
    entries = spark.createDataFrame([("d", "s", 1, ["A", "name 7 (kg)"]), ("d", "s", 2, ["a", "Name 8"]), ("d", "s", 3, ["B", "none"])], "document string, sheet string, row int, terms array<string>")
    found = concepts.dictionary_terms(entries, names, names.selectExpr("concept", "cast(substr(concept, 2) as int) as ord"))
    assert {(r["term"], r["concept"]) for r in found.collect()} == {("a", "c7"), ("name7kg", "c7"), ("name8", "c8")}
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_query_equals_the_plain_version(spark, sf_dir):
    from celldag.queries import concepts as queries

    fields, vocabulary, known, _ = queries.part_fields(spark, sf_dir)
    order = ["field", "document", "sheet", "label", "path", "unit", "value", "is_formula", "style_role"]
    listed = sorted((tuple(r) for r in vocabulary.select("concept", "ord", "name", "dimension", "keywords", "roles").collect()), key=lambda r: r[1])
    names = [tuple(r) for r in known.collect()]
    wanted = {r["field"]: plain(r, {}, listed, names) for r in fields.select(*order).collect()}
    got = {r["field"]: (r["concept"], r["confidence"], r["decision"]) for r in queries.QUERIES["map_concepts"](spark, sf_dir).collect()}
    assert got == wanted and len(wanted) == 200
    assert sum(w[2] == "auto" for w in wanted.values()) > 40 and sum(w[2] == "pending" for w in wanted.values()) > 20
    pairs = {(r["a"], r["b"]): r["ratio"] for r in queries.QUERIES["similar_names"](spark, sf_dir).collect()}
    texts = {r["label"].lower() for r in fields.collect()}
    assert pairs == {(a, n): q for a in texts for n in {n for _, n in names} if (q := difflib.SequenceMatcher(None, a, n).ratio()) >= 0.55}
