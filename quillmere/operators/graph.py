"""Knowledge graph as tables: lookups, chunk search, hops, components, modularity, extraction hints.

``entities``: id, name, name_en, entity_type, description.  ``relationships``: source_entity_id, target_entity_id, relation_type, weight.
``entity_chunks``: entity_id, chunk_id.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere import errors
from quillmere.functions import text as T
from quillmere.operators import reasoning
from quillmere.operators.lineage import cut, discard
from quillmere.sources.providers import Provider

FUZZY_LIMIT, HOP_LIMIT = 50, 100
#: Sizes of grams by which names are found, and how many of them are broadcast.
GRAMS, MANY_GRAMS = (4, 8, 16), 1 << 18
MIN_SPLIT, MAX_SPLIT, PASSES = 6, 200, 20
RELATIONS = ["amends", "contradicts", "defines", "references", "requires", "supersedes"]
#: Cue verbs by relation, in lower case, English and Spanish.
CUES = {
    "amends": "amend(?:s|ed|ing)?|modif(?:y|ies|ied|ying)|enmiendan?|modifican?|modificad[oa]s?",
    "contradicts": "contradict(?:s|ed|ing)?|conflict(?:s|ed|ing)?|contradicen?",
    "defines": "defin(?:e|es|ed|ing)|definen?|definid[oa]s?",
    "references": "referenc(?:e|es|ed|ing)|refer(?:s|red|ring)?|cit(?:e|es|ed|ing)|citan?|citad[oa]s?",
    "requires": "requir(?:e|es|ed|ing)|depend(?:s|ed|ing)?|mandat(?:e|es|ed|ing)|requieren?|requerid[oa]s?",
    "supersedes": "supersed(?:e|es|ed|ing)|replac(?:e|es|ed|ing)|reemplazan?|reemplazad[oa]s?|sustituyen?|sustituid[oa]s?",
}
KINDS = ["clause", "concept", "organization", "person", "regulation", "standard", "term"]


def both_ways(relationships: DataFrame) -> DataFrame:
    """(node, other, weight): every edge in both directions, so that a join on either end is one equi-join."""
    r = relationships
    return r.select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("other"), "weight").unionByName(r.select(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("other"), "weight"))


def exact_entities(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, name): entities whose name is a term; terms are lower case."""
    return terms.join(entities.select("id", "name"), F.col("term") == F.col("name")).select("query_id", "id", "name").distinct()


def fuzzy_entities(entities: DataFrame, terms: DataFrame, column: str = "name", limit: int = FUZZY_LIMIT) -> DataFrame:
    """(query_id, id, name): entities whose name contains a term of at least four bytes, ``limit`` a query by id.

    Containment has no equi-join key.  Names are cut into grams of 4, 8 and 16 characters, and a term goes by that of its own grams, of the greatest size that fits, which
    fewest names have: a name that contains the term contains all of them, so an equi-join finds all candidates and ``contains`` decides.  Names that differ in their
    numbers only share all short grams, so by these every term would meet every name.
    """
    grams = lambda x, n: F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))))
    any_gram = lambda x: F.flatten(F.array_compact(F.array(*[grams(x, n) for n in GRAMS])))
    long = terms.where((F.octet_length("term") >= 4) & (F.length("term") >= 4)).select("query_id", F.lower("term").alias("term")).distinct()
    cut_up = long.select("term").distinct().select("term", F.explode(F.coalesce(*[grams(F.col("term"), n) for n in reversed(GRAMS)])).alias("gram"))
    looked_for = cut_up.select("gram").distinct()
    if looked_for.limit(MANY_GRAMS + 1).count() <= MANY_GRAMS:
        looked_for = F.broadcast(looked_for)  # else both sides are shuffled
    named = entities.where(F.col(column).isNotNull()).select("id", F.col(column).alias("name"), F.lower(column).alias("low"))
    names = named.select("id", "name", "low", F.explode(any_gram(F.col("low"))).alias("gram")).join(looked_for, "gram", "left_semi")
    common = names.groupBy("gram").agg(F.count(F.lit(1)).alias("q_names"))
    rarest = cut_up.join(common, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("q_names", F.lit(0)), "gram")).alias("gram"))
    hits = long.join(rarest.join(names, "gram").where(F.contains("low", F.col("term"))).select("term", "id", "name"), "term").select("query_id", "id", "name").distinct()
    return hits.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).where(F.col("n") <= limit).drop("n")


def matched_entities(entities: DataFrame, terms: DataFrame, limit: int = FUZZY_LIMIT) -> DataFrame:
    """(query_id, id, found_by): exact, then fuzzy, then by English name; the first way that finds an entity counts."""
    ways = [(1, "exact", exact_entities(entities, terms)), (2, "fuzzy", fuzzy_entities(entities, terms, "name", limit))]
    if "name_en" in entities.columns:
        ways.append((3, "name_en", fuzzy_entities(entities, terms, "name_en", limit)))
    union = None
    for n, way, df in ways:
        part = df.select("query_id", "id", F.lit(n).alias("n"), F.lit(way).alias("way"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "id").agg(F.min_by("way", "n").alias("found_by"))


def search_chunks(seeds: DataFrame, entity_chunks: DataFrame, relationships: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks of the seeds by the greatest weight of any edge of an entity; 0.5 without edges.

    The greatest weight of each entity is aggregated first; a join on "source or target" would be a nested loop.  With ``top``, chunks are looked for among the ``top`` least
    of every entity with edges, cut in each task before they are shuffled: all chunks of such an entity score at least its weight, so a later one has ``top`` others before it.
    So each of the best has its score by an entity among whose least chunks it is, and what else is found scores no more than it should: no chunk need be looked up again.
    Only chunks of entities without edges are, as any weight takes the place of their 0.5.
    """
    seeds = seeds.select("query_id", F.col("id").alias("entity_id")).distinct()
    seeds = seeds if top is None else cut(seeds, "seeds")  # used by every step
    ends = F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")
    strongest = relationships.select(ends, "weight").groupBy("entity_id").agg(F.max("weight").alias("w"))
    if top is None:
        scored = seeds.join(entity_chunks, "entity_id").join(strongest, "entity_id", "left").groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("w"), F.lit(0.5)).alias("score"))
        return scored.withColumn("rank", _rank())
    strongest = cut(strongest.where("w is not null").join(seeds.select("entity_id").distinct(), "entity_id", "left_semi"), "strongest")
    weighed = seeds.join(strongest, "entity_id")
    place = F.dense_rank().over(W.partitionBy("entity_id").orderBy("chunk_id"))
    first = entity_chunks.join(strongest.select("entity_id"), "entity_id", "left_semi").withColumn("q_place", place).where(F.col("q_place") <= top).select("entity_id", "chunk_id").distinct()
    scored = weighed.join(first, "entity_id").groupBy("query_id", "chunk_id").agg(F.max("w").alias("score"))
    bare = seeds.join(strongest, "entity_id", "left_anti")
    if not bare.isEmpty():
        loose = bare.join(entity_chunks, "entity_id").select("query_id", "chunk_id").distinct()
        more = loose.join(entity_chunks, "chunk_id").join(weighed, ["query_id", "entity_id"]).groupBy("query_id", "chunk_id").agg(F.max("w").alias("w"))
        extra = loose.join(more, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("w", F.lit(0.5)).alias("score"))
        scored = scored.unionByName(extra).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", _rank()).where(F.col("rank") <= top)


def _rank() -> Column:
    return F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("bigint")


def neighbours(seeds: DataFrame, relationships: DataFrame, limit: int | None = HOP_LIMIT) -> DataFrame:
    """(query_id, id): entities one edge away from a query's seeds, without the seeds."""
    start = seeds.select("query_id", F.col("id").alias("node")).distinct()
    near = start.join(both_ways(relationships), "node").select("query_id", F.col("other").alias("id")).distinct()
    new = near.join(seeds.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    if limit is None:
        return new
    return new.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).where(F.col("n") <= limit).drop("n")


def traverse(seeds: DataFrame, relationships: DataFrame, depth: int) -> DataFrame:
    """(query_id, id, depth): breadth-first, both directions; a negative depth reaches nothing."""
    if depth < 0:
        return seeds.select("query_id", "id", F.lit(0).alias("depth")).limit(0)
    seen = seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = neighbours(front, relationships, None).join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def components(nodes: DataFrame, relationships: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id that can be reached over edges of any direction; a node without edges is its own.

    Each round takes the least label of a node and its neighbours and then jumps to the label's own label, so paths shrink by half; lineage is cut
    through the shared folder.
    """
    edges = cut(both_ways(relationships).select("node", "other").distinct(), "edges")
    labels = cut(nodes.select("id").distinct().withColumn("component", F.col("id")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy(F.col("node").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("hook"))
        parents = hooked.select(F.col("id").alias("hook"), F.col("hook").alias("up"))
        jumped = cut(hooked.join(parents, "hook", "left").select("id", F.coalesce("up", "hook").alias("new"), "component"), "labels")
        discard(labels)
        done = jumped.where("new <> component").isEmpty()
        labels = jumped.select("id", F.col("new").alias("component"))
        if done:
            discard(edges)
            return labels
    raise RuntimeError("the components did not settle")


def split_by_modularity(nodes: list[int], edges: list[tuple[int, int, float]], total: float) -> dict[int, int]:
    """Node -> label: greedy moves to the neighbouring community of greatest gain, in passes; ties go to the lesser label.

    ``total`` is the weight of the whole graph, by which gains are measured.
    """
    links: dict[int, dict[int, float]] = {n: {} for n in nodes}
    for a, b, w in edges:
        links[a][b] = links[a].get(b, 0.0) + w
        links[b][a] = links[b].get(a, 0.0) + w
    label = {n: n for n in nodes}
    strength = {n: sum(links[n].values()) for n in nodes}
    inside = dict(strength)
    m2 = 2 * total
    for _ in range(PASSES):
        moved = False
        for n in sorted(nodes):
            k, own = strength[n], label[n]
            toward: dict[int, float] = {}
            for other, w in links[n].items():
                toward[label[other]] = toward.get(label[other], 0.0) + w
            stay = toward.get(own, 0.0) / m2 - inside[own] * k / (m2 * m2)
            best, gain = own, 0.0
            for c in sorted(toward):
                g = toward[c] / m2 - inside[c] * k / (m2 * m2) - stay
                if c != own and g > gain:
                    best, gain = c, g
            if best != own:
                inside[own] -= k
                inside[best] += k
                label[n], moved = best, True
        if not moved:
            break
    return label


def communities(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """(level, community, entity_ids): components at level 0; those of 6 to 200 nodes split by modularity at level 1, each in one task."""
    # read by several steps, and it may be dear to make: of nearest neighbours, say
    relationships = cut(relationships.select("source_entity_id", "target_entity_id", "weight"), "relationships")
    placed = cut(components(nodes, relationships), "components")
    zero = placed.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("entity_ids")).select(F.lit(0).alias("level"), F.col("component").alias("community"), "entity_ids")
    total = relationships.agg(F.sum("weight")).first()[0] or 0.0
    if total <= 0:
        return zero
    sized = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n between {MIN_SPLIT} and {MAX_SPLIT}").select("component")
    members = placed.join(sized, "component")
    inner = relationships.join(members.select(F.col("id").alias("source_entity_id"), "component"), "source_entity_id").select("component", F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"), F.col("weight").cast("double").alias("w"))
    rows = members.select("component", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("w")).unionByName(inner)

    def split(group: pa.Table) -> pa.Table:
        r = group.to_pylist()
        label = split_by_modularity([x["a"] for x in r if x["b"] is None], [(x["a"], x["b"], x["w"]) for x in r if x["b"] is not None], total)
        return pa.table({"id": pa.array(list(label), pa.int64()), "label": pa.array(list(label.values()), pa.int64())})

    one = rows.groupBy("component").applyInArrow(split, "id bigint, label bigint").groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))
    return zero.unionByName(one.select(F.lit(1).alias("level"), F.array_min("entity_ids").alias("community"), "entity_ids"))


def community_text(communities_: DataFrame, entities: DataFrame) -> DataFrame:
    """(level, community, text): one line ``- name (type): description`` for every member, the input of a summary."""
    rows = communities_.select("level", "community", F.explode("entity_ids").alias("id")).join(entities, "id")
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "entity_type", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(F.lit("")))
    return rows.groupBy("level", "community").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])).alias("text"))


def language_vote(chunks: DataFrame, key: str, language: str) -> DataFrame:
    """(key, language, votes): the commonest language; of equals the first by name."""
    votes = chunks.where(F.coalesce(F.col(language), F.lit("")) != "").groupBy(key, language).agg(F.count(F.lit(1)).alias("votes"))
    return votes.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("votes"), language))).where("n = 1").drop("n")


def resolve_endpoints(edges: DataFrame, local: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds source_entity_id and target_entity_id to edges of names: by the chunk's own entities first, else the least id of that name anywhere.

    ``edges``: chunk_id, source, target, relation_type, weight (names lower case).  ``local``: chunk_id, name, id.  Edges without an end are dropped; a weight of
    0 or less is 1.
    """
    anywhere = entities.groupBy("name").agg(F.min("id").alias("any_id"))
    own = local.groupBy("chunk_id", "name").agg(F.min("id").alias("own_id"))
    out = edges
    for side in ("source", "target"):
        out = out.join(own.select("chunk_id", F.col("name").alias(side), F.col("own_id").alias(f"{side}_own")), ["chunk_id", side], "left")
        out = out.join(anywhere.select(F.col("name").alias(side), F.col("any_id").alias(f"{side}_any")), side, "left")
        out = out.withColumn(f"{side}_entity_id", F.coalesce(f"{side}_own", f"{side}_any"))
    more = [c for c in ("description",) if c in edges.columns]
    return out.where("source_entity_id is not null and target_entity_id is not null").select("chunk_id", "source_entity_id", "target_entity_id", "relation_type", F.when(F.coalesce("weight", F.lit(0.0)) <= 0, 1.0).otherwise(F.col("weight")).alias("weight"), *more)


def _wide(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk_id, content) of the chunks of an estimate of at least 30 tokens."""
    return chunks.where(T.token_estimate(T.n_words(F.col(text))) >= 30).select(F.col(key).alias("chunk_id"), F.col(text).alias("content"))


def _identified(text: Column) -> Column:
    """Whether a lower-case text may have an identifier: all patterns that lower case leaves need a digit or ``rev``."""
    return text.rlike("[0-9]") | F.contains(text, F.lit("rev"))


def _cued(wide: DataFrame) -> DataFrame:
    """(chunk_id, source, target, relation_type) of identifiers of one sentence with a cue verb between them; of several the last, the one beside the target.

    A verb with "by" or "por" turns the relation round: what is superseded by another is its target.
    """
    verb = "|".join(f"(?:{v})" for v in CUES.values())
    cue = rf"\b((?:{verb})(?:\s+(?:by|por)\b)?)(?!\w)"
    # two identifiers are rarer than a verb and found sooner
    sentence = wide.where(_identified(F.lower("content"))).select("chunk_id", F.explode(T.sentences(F.lower("content"))).alias("s")).where(_identified(F.col("s")))
    names = F.array_distinct(F.transform(F.filter(T.identifiers(F.col("s")), lambda x: x != ""), lambda x: F.lower(x)))
    places = F.transform(names, lambda x: F.struct(F.call_function("instr", F.col("s"), x).alias("at"), x.alias("name")))
    here = sentence.withColumn("here", F.filter(places, lambda x: x["at"] > 0)).where(F.size("here") > 1).where(F.col("s").rlike(cue))
    pairs = here.select("chunk_id", "s", "here", F.explode("here").alias("a")).select("chunk_id", "s", "a", F.explode("here").alias("b")).where("b.at >= a.at + length(a.name)")
    last = F.regexp_extract(F.expr("substring(s, a.at + length(a.name), b.at - a.at - length(a.name))"), f"(?s).*{cue}", 1)
    found = pairs.select("chunk_id", F.col("a.name").alias("left"), F.col("b.name").alias("right"), last.alias("cue")).where("cue <> ''")
    kind = F.coalesce(*[F.when(F.col("cue").rlike(f"^(?:{v})"), F.lit(k)) for k, v in CUES.items()])
    back = F.col("cue").rlike(r"\s(?:by|por)$")
    return found.select("chunk_id", F.when(back, F.col("right")).otherwise(F.col("left")).alias("source"), F.when(back, F.col("left")).otherwise(F.col("right")).alias("target"), kind.alias("relation_type")).distinct()


def by_rules(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges) without a model. ``wide``: chunk_id, content."""
    ids = F.array_remove(T.identifiers(F.col("content")), "")
    found = wide.select("chunk_id", F.posexplode(ids).alias("pos", "name")).groupBy("chunk_id", F.lower("name").alias("name")).agg(F.min("pos").alias("pos"))
    kind = F.when(F.col("name").rlike(f"(?i)^(?:{T.STANDARD[4:]})$"), "standard").otherwise("term")
    mentions = found.select("chunk_id", "name", kind.alias("entity_type"), "pos")
    a, b = mentions.alias("a"), mentions.alias("b")
    pairs = a.join(b, (F.col("a.chunk_id") == F.col("b.chunk_id")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.chunk_id").alias("chunk_id"), F.col("a.name").alias("source"), F.col("b.name").alias("target"))
    # one window tells which pairs have a cue in either direction; a join against them would find the cues a second time
    told = pairs.withColumn("relation_type", F.lit("references")).withColumn("q_cued", F.lit(0)).unionByName(_cued(wide).withColumn("q_cued", F.lit(1)))
    either = W.partitionBy("chunk_id", F.least("source", "target"), F.greatest("source", "target"))
    edges = told.withColumn("q_any", F.max("q_cued").over(either)).where("q_cued = q_any").drop("q_cued", "q_any")
    return mentions.drop("pos"), edges.withColumn("weight", F.lit(1.0))


_TOLD = "language string, entities array<struct<name:string,type:string,description:string,name_en:string>>"
_RELATED = "relationships array<struct<source:string,target:string,relation_type:string,description:string,weight:double>>"


def _name(c):
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def asked(wide: DataFrame, provider: Provider) -> DataFrame:
    """(chunk_id, content, language, entities, relationships, error) of every chunk, as a model tells them in two calls; the second needs two entities.

    Without a usable first reply ``entities`` is null and ``error`` says why; a failed second call leaves the entities.
    """
    hints = F.array_join(F.array_distinct(F.filter(T.identifiers(F.col("content")), lambda x: x != "")), ", ")
    first = F.concat(
        F.lit(f'Extract all entities from the text, each of one type of: {", ".join(KINDS)}. Names in lower case, name_en being the name in English. Take only what the text supports.\n'
              'Reply with one JSON object alone: {"language": name of the text\'s language in English, "entities": [{"name": "", "type": "", "description": "", "name_en": ""}]}\n'),
        F.when(hints != "", F.concat(F.lit("These identifiers are in the text and belong to the entities: "), hints, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\nTEXT:\n"), F.col("content"),
    )
    told = cut(reasoning.ask(wide.withColumn("q_prompt", first), "q_prompt", "q_reply", provider), "told")
    read = F.from_json(reasoning.salvage_json(F.col("q_reply")), _TOLD)
    told = told.select("chunk_id", "content", read["language"].alias("language"), F.filter(read["entities"], lambda e: _name(e["name"]) != "").alias("entities"), "q_reply_error")
    told = told.withColumn("error", F.when(F.col("entities").isNull(), F.coalesce("q_reply_error", F.lit("no entities in the reply")))).drop("q_reply_error")
    second = F.concat(
        F.lit(f'Extract all relationships between the known entities that the text supports, each of one type of: {", ".join(RELATIONS)}. The weight is the confidence from 0 to 1.\n'
              'Reply with one JSON object alone: {"relationships": [{"source": "", "target": "", "relation_type": "", "description": "", "weight": 0}]}\nKNOWN ENTITIES:\n'),
        F.to_json(F.transform("entities", lambda e: _name(e["name"]))), F.lit("\n\nTEXT:\n"), F.col("content"),
    )
    more = told.withColumn("q_prompt", second).withColumn("q_where", F.coalesce(F.size("entities") > 1, F.lit(False)))
    related = reasoning.ask(more, "q_prompt", "q_reply", provider, "q_where")
    return cut(related.select(*told.columns, F.from_json(reasoning.salvage_json(F.col("q_reply")), _RELATED)["relationships"].alias("relationships")), "related")


def extract(chunks: DataFrame, key: str = "chunk_id", text: str = "content", provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges).  With a provider a model names entities and relations, and mentions also have description, name_en and the chunk's language, edges a description; a chunk
    for which it gives no usable reply goes by the rules, and if it fails for all of them ``ExtractionFailed`` is raised.

    The rules: identifiers are entities, typed by pattern; two of one sentence are related by a cue verb between them (English and Spanish), other two of one
    chunk as references.  Chunks of an estimate under 30 tokens are left out.
    """
    if provider is None:
        return by_rules(_wide(chunks.where(T.may_have_identifier(F.col(text))), key, text))  # others have neither mentions nor edges
    wide = _wide(chunks, key, text)
    told = asked(wide, provider)
    n = told.agg(F.count(F.lit(1)).alias("all"), F.count("entities").alias("good"), F.min("error").alias("error")).first()
    if n["all"] and not n["good"]:
        raise errors.ExtractionFailed(n["error"])
    e, r = F.col("e"), F.col("r")
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = F.coalesce(F.nullif(_name(e["type"]), F.lit("")), F.lit("concept"))
    named = told.select("chunk_id", "language", F.explode("entities").alias("e")).select("chunk_id", "language", _name(e["name"]).alias("name"), kind.alias("entity_type"), full(e["description"]).alias("description"), F.nullif(_name(e["name_en"]), F.lit("")).alias("name_en"))
    named = named.groupBy("chunk_id", "name", "entity_type").agg(F.max("description").alias("description"), F.max("name_en").alias("name_en"), F.max(full(F.col("language"))).alias("language"))
    verb = F.coalesce(F.nullif(_name(r["relation_type"]), F.lit("")), F.lit("references"))
    tied = told.select("chunk_id", F.explode("relationships").alias("r")).select("chunk_id", _name(r["source"]).alias("source"), _name(r["target"]).alias("target"), verb.alias("relation_type"), r["weight"].alias("weight"), full(r["description"]).alias("description"))
    mentions, edges = by_rules(told.where("entities is null").select("chunk_id", "content"))
    return named.unionByName(mentions, allowMissingColumns=True), tied.where("source <> '' and target <> ''").unionByName(edges, allowMissingColumns=True)
