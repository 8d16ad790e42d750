"""OWL-RL entailment by semi-naive rounds: only what the last round added is joined again.

The schema is closed first: classes and properties under their order and their equivalences, and what a property says of its
ends, with all classes above. Then each round joins the triples that are new with the schema, and for transitive properties
and chains with all triples, on either side. Equal individuals are one: a triple is kept for one of them, the smallest, and
``same`` says whom it stands for. What functional properties make equal is merged between rounds, and only triples that the
merging changed are new. Rounds go on until nothing is new, so a path of any length closes in a logarithmic number of them.

Triples are (s, p, o), names without a namespace: type, subClassOf, subPropertyOf, equivalentClass, equivalentProperty, domain,
range, inverseOf, disjointWith, propertyDisjointWith, sameAs, differentFrom; property kinds are types (TransitiveProperty and so
on). Triples with a null don't count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import connected_components
from graphloom.session import dropped
from graphloom.session import written as cut

SCHEMA = ("subClassOf", "subPropertyOf", "equivalentClass", "equivalentProperty", "domain", "range", "inverseOf", "disjointWith", "propertyDisjointWith")
KINDS = ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty")
NOTHING = "Nothing"


@dataclass
class Closure:
    """triples: all that hold, individuals by their representative. same: node, representative, of those that aren't their own.
    problems: node, problem, other; none where the triples are consistent. rounds: how many it took."""

    triples: DataFrame
    same: DataFrame
    problems: DataFrame
    rounds: int


def closed(pairs: DataFrame) -> DataFrame:
    """(a, b) of all paths of the given pairs; lengths double in each round."""
    known = cut(pairs.select("a", "b").where("a <> b").distinct())
    new = known
    while not new.isEmpty():
        on = lambda x, y: x.join(y.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        found = cut(on(new, known).unionAll(on(known, new)).where("a <> b").distinct().join(known, ["a", "b"], "left_anti"))
        more = cut(known.unionAll(found))
        dropped(*({id(t): t for t in (known, new)}.values()))
        known, new = more, found
    return known


class Schema:
    """What the rules read besides the triples; all of it written tables."""

    def __init__(self, triples: DataFrame, chains: DataFrame | None):
        of = lambda *names: triples.where(F.col("p").isin(*names)).select(F.col("s").alias("a"), F.col("o").alias("b"))
        turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        self.classes = closed(of("subClassOf", "equivalentClass").unionAll(turned(of("equivalentClass"))))
        self.properties = closed(of("subPropertyOf", "equivalentProperty").unionAll(turned(of("equivalentProperty"))))
        self.inverse = cut(of("inverseOf").unionAll(turned(of("inverseOf"))).unionAll(self.kind(triples, "SymmetricProperty").select(F.col("p").alias("a"), F.col("p").alias("b"))).distinct())
        self.ends = {name: self.end(of(name)) for name in ("domain", "range")}
        self.disjoint = cut(of("disjointWith").unionAll(turned(of("disjointWith"))).distinct())
        self.apart = cut(of("propertyDisjointWith").unionAll(turned(of("propertyDisjointWith"))).distinct())
        self.transitive, self.functional, self.inverse_functional, self.irreflexive, self.asymmetric = (cut(self.kind(triples, k)) for k in ("TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty"))
        self.chains = chains
        self.has = {name: not getattr(self, name).isEmpty() for name in ("transitive", "functional", "inverse_functional", "irreflexive", "asymmetric", "apart")}

    def kind(self, triples: DataFrame, name: str) -> DataFrame:
        return triples.where((F.col("p") == "type") & (F.col("o") == name)).select(F.col("s").alias("p")).distinct()

    def end(self, given: DataFrame) -> DataFrame:
        """(a, b): the classes of one end of a property, those of properties above it and classes above them as well."""
        by = given.unionAll(self.properties.select("a", F.col("b").alias("m")).join(given.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
        up = by.select("a", F.col("b").alias("m")).join(self.classes.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        return cut(by.unionAll(up).distinct())


def _step(new: DataFrame, known: DataFrame, sc: Schema) -> DataFrame:
    """What follows from a new triple and the schema, or from a new triple and any other."""
    by = lambda t: t.select(F.col("a").alias("p"), F.col("b").alias("q"))
    typed = lambda node: (F.col(node).alias("s"), F.lit("type").alias("p"), F.col("q").alias("o"))
    types = new.where("p = 'type'").select("s", F.col("o").alias("a"))
    out = types.join(sc.classes, "a").select("s", F.lit("type").alias("p"), F.col("b").alias("o"))
    out = out.unionAll(new.join(by(sc.properties), "p").select("s", F.col("q").alias("p"), "o"))
    out = out.unionAll(new.join(by(sc.inverse), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o")))
    out = out.unionAll(new.join(by(sc.ends["domain"]), "p").select(*typed("s"))).unionAll(new.join(by(sc.ends["range"]), "p").select(*typed("o")))
    next_ = lambda t, p="p": t.select(F.col("s").alias("m"), F.col(p).alias("r"), F.col("o").alias("end"))
    if sc.has["transitive"]:
        a, b = new.join(sc.transitive, "p", "left_semi"), known.join(sc.transitive, "p", "left_semi")
        for x, y in ((a, b), (b, a)):
            out = out.unionAll(x.join(next_(y), (F.col("o") == F.col("m")) & (F.col("p") == F.col("r"))).select("s", "p", F.col("end").alias("o")))
    if sc.chains is not None:
        for x, y in ((new, known), (known, new)):
            first = x.join(sc.chains, F.col("p") == F.col("first")).select("s", F.col("o").alias("m"), F.col("second").alias("r"), "derived")
            out = out.unionAll(first.join(next_(y), ["m", "r"]).select("s", F.col("derived").alias("p"), F.col("end").alias("o")))
    return out


def _named(triples: DataFrame, same: DataFrame) -> DataFrame:
    """Triples with individuals replaced by their representatives; classes of a type stay."""
    for c in ("s", "o"):
        r = same.select(F.col("node").alias(c), F.col("representative").alias("_r"))
        triples = triples.join(r, c, "left").select(*[F.coalesce("_r", c).alias(c) if k == c else F.col(k) for k in ("s", "p", "o")])
    return triples.distinct()


def _equal(pairs: DataFrame) -> DataFrame:
    """node, representative, of all that pairs (src, tgt) make equal, but for the representatives."""
    return connected_components(pairs).where("node <> component").select("node", F.col("component").alias("representative"))


def _merged(known: DataFrame, sc: Schema) -> DataFrame | None:
    """(src, tgt): what functional properties make equal, each value with the least of its key."""
    out = None
    for name, key, value in (("functional", "s", "o"), ("inverse_functional", "o", "s")):
        if sc.has[name]:
            own = known.join(getattr(sc, name), "p", "left_semi").select("p", F.col(key).alias("k"), F.col(value).alias("tgt"))
            least = own.groupBy("p", "k").agg(F.min("tgt").alias("src"), F.max("tgt").alias("_most")).where("src < _most").select("p", "k", "src")
            found = own.join(least, ["p", "k"]).where("src <> tgt").select("src", "tgt")
            out = found if out is None else out.unionAll(found)
    return None if out is None else out.distinct()


def closure(triples: DataFrame, chains: list[tuple[str, str, str]] | None = None) -> Closure:
    """All that follows from triples (s, p, o). chains: (first, second, derived): first o second is derived."""
    spark = triples.sparkSession
    given = cut(triples.select("s", "p", "o").dropna().distinct())
    sc = Schema(given, spark.createDataFrame(chains, "first string, second string, derived string") if chains else None)
    facts = given.where(~F.col("p").isin(*SCHEMA, "sameAs", "differentFrom"))
    same = cut(_equal(given.where("p = 'sameAs'").select(F.col("s").alias("src"), F.col("o").alias("tgt"))))
    known, rounds = cut(_named(facts, same)), 0
    new = known
    while not new.isEmpty():
        rounds += 1
        found = cut(_step(new, known, sc).distinct().join(known, ["s", "p", "o"], "left_anti"))
        more = cut(known.unionAll(found))
        pairs = _merged(more, sc)
        pairs = None if pairs is None else cut(pairs)
        if pairs is not None and not pairs.isEmpty():
            now = cut(_equal(pairs))
            moved = same.join(now.select(F.col("node").alias("representative"), F.col("representative").alias("_r")), "representative", "left").select("node", F.coalesce("_r", "representative").alias("representative"))
            same = cut(moved.unionByName(now))
            after = cut(_named(more, now))
            found = cut(after.join(known, ["s", "p", "o"], "left_anti"))
            dropped(more)
            more = after
        dropped(*({id(t): t for t in (known, new)}.values()))
        known, new = more, found
    schema = sc.classes.select(F.col("a").alias("s"), F.lit("subClassOf").alias("p"), F.col("b").alias("o")).unionAll(sc.properties.select(F.col("a").alias("s"), F.lit("subPropertyOf").alias("p"), F.col("b").alias("o")))
    problems = cut(_problems(known, given, same, sc))
    empty = problems.where("problem = 'disjoint classes'").select(F.col("node").alias("s"), F.lit("type").alias("p"), F.lit(NOTHING).alias("o"))
    everything = known.unionAll(given.where(F.col("p").isin(*SCHEMA, "differentFrom"))).unionAll(schema).unionAll(empty)
    return Closure(everything.distinct(), same, problems, rounds)


def _problems(known: DataFrame, given: DataFrame, same: DataFrame, sc: Schema) -> DataFrame:
    """(node, problem, other): what can't all be true."""
    row = lambda df, node, problem, other: df.select(F.col(node).alias("node"), F.lit(problem).alias("problem"), F.col(other).alias("other"))
    types = known.where("p = 'type'").select("s", F.col("o").alias("a"))
    both = types.join(sc.disjoint, "a").join(types.select("s", F.col("a").alias("b")), ["s", "b"]).where("a <= b")
    out = row(both.withColumn("pair", F.concat("a", F.lit(" "), "b")), "s", "disjoint classes", "pair").unionAll(row(types.where(F.col("a") == NOTHING), "s", "member of nothing", "a"))
    apart = _named(given.where("p = 'differentFrom'"), same).where("s = o")
    out = out.unionAll(row(apart, "s", "different but the same", "o"))
    if sc.has["irreflexive"]:
        out = out.unionAll(row(known.where("s = o").join(sc.irreflexive, "p", "left_semi"), "s", "irreflexive", "p"))
    if sc.has["asymmetric"]:
        one = known.join(sc.asymmetric, "p", "left_semi")
        out = out.unionAll(row(one.join(one.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"]), "s", "asymmetric", "p"))
    if sc.has["apart"]:
        twice = known.select("s", "o", F.col("p").alias("a")).join(sc.apart, "a").join(known.select("s", "o", F.col("p").alias("b")), ["s", "o", "b"]).where("a <= b")
        out = out.unionAll(row(twice.withColumn("pair", F.concat("a", F.lit(" "), "b")), "s", "disjoint properties", "pair"))
    return out.distinct()


def entailed(triples: DataFrame, chains: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(s, p, o) that follow from the triples and aren't among them; of equal individuals, for their representative, and
    sameAs from each of the others to it."""
    c = closure(triples, chains)
    own = c.triples.unionAll(c.same.select(F.col("node").alias("s"), F.lit("sameAs").alias("p"), F.col("representative").alias("o")))
    return own.join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
