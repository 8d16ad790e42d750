"""OWL-RL closure against rules applied one by one until nothing changes."""

import random

import pytest

from graphloom.operators import owl

TBOX = [("Cat", "subClassOf", "Animal"), ("Animal", "subClassOf", "Being"), ("Feline", "equivalentClass", "Cat"), ("Plant", "disjointWith", "Animal"), ("Stone", "subClassOf", "Nothing"), ("feeds", "domain", "Being"), ("feeds", "range", "Animal"), ("owns", "subPropertyOf", "knows"), ("knows", "subPropertyOf", "meets"), ("meets", "domain", "Being"), ("meets", "type", "SymmetricProperty"), ("above", "type", "TransitiveProperty"), ("above", "inverseOf", "under"), ("wed", "equivalentProperty", "married"), ("married", "type", "FunctionalProperty"), ("tag", "type", "InverseFunctionalProperty"), ("above", "type", "IrreflexiveProperty"), ("eats", "type", "AsymmetricProperty"), ("eats", "propertyDisjointWith", "owns")]
CHAINS = [("parent", "sibling", "uncle")]


def brute(triples):
    """(triples, representative of each, problems), all individuals by the smallest name that is equal to them."""
    t, rep = set(triples), {}

    def find(x):
        while rep.get(x, x) != x:
            x = rep[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b:
            rep[max(a, b)] = min(a, b)
            return True
        return False

    schema = set(owl.SCHEMA)
    for s, p, o in t:
        if p == "sameAs":
            join(s, o)
    t = {(s, p, o) for s, p, o in t if p != "sameAs"}
    while True:
        t = {(s, p, o) if p in schema or p == "differentFrom" else (find(s), p, find(o)) for s, p, o in t}
        new, of = set(), lambda p: [(s, o) for s, q, o in t if q == p]
        kind = lambda k: {s for s, o in of("type") if o == k}
        sub, subp = set(of("subClassOf")), set(of("subPropertyOf"))
        for pairs, name in ((of("equivalentClass"), "subClassOf"), (of("equivalentProperty"), "subPropertyOf")):
            new |= {(x, name, y) for a, b in pairs for x, y in ((a, b), (b, a))}
        new |= {(a, "subClassOf", d) for a, b in sub for c, d in sub if b == c and a != d} | {(a, "subPropertyOf", d) for a, b in subp for c, d in subp if b == c and a != d}
        facts = [x for x in t if x[1] not in schema and x[1] != "differentFrom"]
        inverse = set(of("inverseOf")) | {(b, a) for a, b in of("inverseOf")} | {(p, p) for p in kind("SymmetricProperty")}
        for s, p, o in facts:
            new |= {(s, "type", d) for c, d in sub if p == "type" and o == c} | {(s, q, o) for r, q in subp if r == p} | {(o, q, s) for r, q in inverse if r == p}
            new |= {(s, "type", c) for r, c in of("domain") if r == p} | {(o, "type", c) for r, c in of("range") if r == p}
            for s2, p2, o2 in facts:
                if o == s2 and p == p2 and p in kind("TransitiveProperty"):
                    new.add((s, p, o2))
                new |= {(s, d, o2) for a, b, d in CHAINS if p == a and p2 == b and o == s2}
        merged = False
        for s, p, o in facts:
            for s2, p2, o2 in facts:
                if p == p2 and s == s2 and o != o2 and p in kind("FunctionalProperty"):
                    merged |= join(o, o2)
                if p == p2 and o == o2 and s != s2 and p in kind("InverseFunctionalProperty"):
                    merged |= join(s, s2)
        if new <= t and not merged:
            break
        t |= new
    types, bad = {(s, o) for s, o in of("type")}, set()
    for a, b in of("disjointWith"):
        bad |= {(s, "disjoint classes", f"{min(a, b)} {max(a, b)}") for s, c in types if c == a and (s, b) in types}
    bad |= {(s, "member of nothing", c) for s, c in types if c == "Nothing"} | {(find(a), "different but the same", find(a)) for a, b in of("differentFrom") if find(a) == find(b)}
    for s, p, o in t:
        if s == o and p in kind("IrreflexiveProperty"):
            bad.add((s, "irreflexive", p))
        if p in kind("AsymmetricProperty") and (o, p, s) in t:
            bad.add((s, "asymmetric", p))
        for a, b in of("propertyDisjointWith"):
            if p == a and (s, b, o) in t:
                bad.add((s, "disjoint properties", f"{min(a, b)} {max(a, b)}"))
    t |= {(s, "type", "Nothing") for s, k, _ in bad if k == "disjoint classes"}
    return t, {x: find(x) for x in rep if find(x) != x}, bad


def facts(seed, n):
    rng = random.Random(seed)
    names = [f"i{k:02d}" for k in range(14)]
    out = [(rng.choice(names), rng.choice(["feeds", "owns", "knows", "above", "under", "wed", "tag", "eats", "parent", "sibling"]), rng.choice(names)) for _ in range(n)]
    out += [(rng.choice(names), "type", rng.choice(["Cat", "Feline", "Plant", "Animal", "Stone"])) for _ in range(4)]
    return out + [("i00", "sameAs", "i13"), ("i13", "sameAs", "twin"), ("i01", "differentFrom", "i02")]


@pytest.mark.parametrize(("seed", "n"), [(1, 10), (2, 22)])
def test_equals_brute_force(spark, seed, n):
    triples = TBOX + facts(seed, n)
    want, rep, bad = brute(triples)
    c = owl.closure(spark.createDataFrame([*triples, triples[0], (None, "type", "Cat")], "s string, p string, o string"), CHAINS)
    assert {tuple(r) for r in c.triples.collect()} == want
    assert {r.node: r.representative for r in c.same.collect()} == rep
    assert {tuple(r) for r in c.problems.collect()} == bad and bad


def test_a_long_path_closes_in_few_rounds(spark):
    n = 70
    triples = [("above", "type", "TransitiveProperty")] + [(f"n{i:02d}", "above", f"n{i + 1:02d}") for i in range(n)]
    c = owl.closure(spark.createDataFrame(triples, "s string, p string, o string"))
    assert c.triples.where("p = 'above'").count() == n * (n + 1) // 2 and c.rounds <= 9 and c.problems.isEmpty() and c.same.isEmpty()


def test_nothing_follows_from_nothing(spark):
    df = spark.createDataFrame([], "s string, p string, o string")
    assert owl.entailed(df).count() == 0 and owl.closure(df).rounds == 0
