"""Recipe application and proposals against plain loops, with nulls, repeats and empty tables."""

import random
import re

from celldag.operators import recipes

NODES = "document string, node int, path string, type string, name string, data_type string, mapped boolean, concept string"
TEMPLATE = "path string, type string, name string, concept string, tier string, support long, total long, dissent array<struct<concept:string,support:long>>"
CONCEPTS = "concept string, canonical_name string, data_type string, status string"


def plain(nodes, template, concepts):
    """One node after the other, as the docstring says."""
    known = {c[0]: c for c in concepts}
    exact = {}
    for e in template:
        old = exact.get(e[:3])
        if old is None or (-e[5], e[3]) < (-old[5], old[3]):
            exact[e[:3]] = e
    loose = {}
    cut = lambda p: "/".join(re.sub(r"^([A-Z_]+):[0-9a-f]*#\d+$", r"\1", x) for x in (p or "").split("/"))
    for e in exact.values():
        loose.setdefault((cut(e[0]), e[1], e[2]), []).append(e)
    out = []
    for doc, node, path, kind, name, dtype, mapped, _ in nodes:
        if kind not in ("HEADER", "SUB_HEADER"):
            continue
        if mapped:
            out.append((doc, node, None, None, "skipped_mapped", None, None, None))
            continue
        e, how = exact.get((path, kind, name)), "exact"
        if e is None:
            found = loose.get((cut(path), kind, name), [])
            e, how = (found[0], "relaxed") if len(found) == 1 else (None, None)
        if e is None:
            continue
        c = known.get(e[3])
        if c is None or c[3] != "ACTIVE":
            out.append((doc, node, e[3], how, "skipped_stale", None, None, None))
            continue
        bad = (dtype, c[2]) in (("numeric", "text"), ("numeric", "category"), ("text", "numeric"), ("text", "datetime"))
        share = int(e[5] * 1000 / e[6] + 0.5) / 1000
        confidence = 0.6 if how == "relaxed" else share if e[7] else 0.6 if bad else 1.0 if e[4] == "APPROVED" else 0.9
        names = [c[1], *[known[d[0]][1] if d[0] in known and known[d[0]][1] is not None else d[0] for d in e[7] or []]]
        review = how == "relaxed" or bool(e[7]) or bad
        out.append((doc, node, e[3], how, "review" if review else "applied", confidence, "REVIEW_REQUIRED" if review else "AUTO_APPROVED", names))
    return sorted(out, key=repr)


def test_application_equals_plain_loops(spark):
    rng = random.Random(4)
    paths = ["doc/TABLE:3fa9#0", "doc/TABLE:77#1", "doc/TABLE:#12/SUB_PART:a#0", "doc/TABLE:XY#1", "doc", "", None, "doc/TABLE"]
    kinds, names = ["HEADER", "SUB_HEADER", "CELL", None], ["temp", "mass", "", None]
    for case in range(3):
        nodes = [(rng.choice("ab"), rng.randint(1, 60), rng.choice(paths), rng.choice(kinds), rng.choice(names), rng.choice(["numeric", "text", "mixed", None]), rng.choice([True, False, False, None]), "clash") for _ in range(150)]
        template = [(rng.choice(paths), rng.choice(kinds), rng.choice(names), rng.choice(["c1", "c2", "c3", "gone", None]), rng.choice(["APPROVED", "AUTO"]), n, n + k, [(rng.choice(["c1", "c4", "gone"]), k)] if k else rng.choice([None, []]))
                    for n, k in ((rng.randint(1, 5), rng.choice([0, 0, 1, 2])) for _ in range((12, 40, 4)[case]))]
        # Rows of one key that agree in support and concept may differ otherwise; keep one of them, as either would do.
        template = list({(*t[:4], t[5]): t for t in template}.values())
        concepts = [("c1", "One", "text", "ACTIVE"), ("c2", "Two", "numeric", "ACTIVE"), ("c3", "Three", "category", "RETIRED"), ("c4", None, None, "ACTIVE")]
        got = recipes.apply(spark.createDataFrame(nodes, NODES), spark.createDataFrame(template, TEMPLATE), spark.createDataFrame(concepts, CONCEPTS)).collect()
        found = sorted(((r["document"], r["node"], r["concept"], r["match"], r["outcome"], r["confidence"], r["status"], [c["canonical_name"] for c in r["candidates"]] if r["candidates"] is not None else None) for r in got), key=repr)
        assert found == plain(nodes, template, concepts)


def test_application_of_nothing(spark):
    nodes, template, concepts = (spark.createDataFrame([], s) for s in (NODES, TEMPLATE, CONCEPTS))
    one = spark.createDataFrame([("d", 1, "p", "HEADER", "n", None, None, None)], NODES)
    assert recipes.apply(nodes, template, concepts).count() == 0 and recipes.apply(one, template, concepts).count() == 0 and recipes.summary(recipes.apply(nodes, template, concepts)).count() == 0


def test_a_large_proposal_drops_nothing(spark):
    """620 chosen nodes: each takes part or is told to be stale."""
    nodes = spark.range(600).selectExpr("cast(id as int) node", "concat('d', id % 7) document", "if(id % 50 = 49, 'REMOVED', 'ACTIVE') status", "case id % 3 when 0 then 'K' when 1 then 'degC' end unit")
    mappings = spark.range(600).where("id % 20 <> 3").selectExpr("cast(id as int) node", "case when id % 31 = 0 then 'lost' when id % 2 = 0 then 'temp' else 'rest' end concept", "if(id % 10 = 1, 'REVIEW_REQUIRED', 'APPROVED') status")
    mappings = mappings.unionByName(mappings.where("node % 6 = 0"))
    concepts = spark.createDataFrame([("temp", "Temperature", " Mean Temp. ", "K", "numeric"), ("rest", "Rest", None, None, None), ("temp", "Temperature", " Mean Temp. ", "K", "numeric")], "concept string, canonical_name string, name_en string, unit string, data_type string")
    chosen = spark.range(620).selectExpr("cast(id as int) node", "'x' unit").unionByName(spark.range(5).selectExpr("cast(id as int) node", "'y' unit"))
    fields = {r["concept"]: r for r in recipes.proposal(chosen, nodes, mappings, concepts).collect()}
    left = {r["node"]: r["reason"] for r in recipes.stale(chosen, nodes, mappings, concepts).collect()}
    want = {n: "gone" if n >= 600 or n % 50 == 49 else "unmapped" if n % 20 == 3 else "unknown concept" for n in range(620) if n >= 600 or n % 50 == 49 or n % 20 == 3 or n % 31 == 0}
    assert left == want and sum(r["sources"] + r["review"] for r in fields.values()) + len(left) == 620
    assert fields["temp"]["field_name"] == "mean_temp_" and fields["temp"]["note"] == "K/degC to K" and fields["temp"]["status"] == "OK" and fields["temp"]["documents"] == 7
    assert fields["rest"]["field_name"] == "rest" and fields["rest"]["status"] == "REVIEW" and fields["rest"]["note"].endswith("to review left out")
    assert recipes.proposal(chosen.limit(0), nodes, mappings, concepts).count() == 0 and recipes.stale(chosen.limit(0), nodes, mappings, concepts).count() == 0
