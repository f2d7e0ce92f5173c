"""Personal data by base patterns and bootstrapped contextual extraction (operator 2), DataFrame functions only.

Base spans come from fixed patterns and checks. Contextual extraction starts from them: each base entity, and each
other token that stands in a slot of a base entity, is an instance with lexical patterns around it (its two left
words; its left and right word). Words are what white space parts, whatever they hold; a base entity, or a number in
groups, is one word. Spark scores the bipartite graph of patterns and instances in rounds: a pattern's confidence in a
kind is the score that its distinct instances have for that kind, over their number; an unknown instance's score is
the noisy-or of the confident patterns around it. Unknown instances that reach the threshold become spans of that
kind, without punctuation at their ends, wherever they occur, unless they overlap a base span.

A second graph, of the same scores, holds assignments (`password=...`, `token: "..."`): the name with its sign is the
pattern, the value the instance. Values that look drawn at random (SECRET) and access keys of the public form
(ACCESS_KEY) are the seeds of the kind `secret`. Patterns that such values fill are sure of it, and then every value
that stands in their slot is a secret, whatever it looks like. Access keys are secrets wherever they stand.

The texts with base entities give the patterns first. A second scan looks for the fillers of their slots, and a third
one for the tokens found; both look them up in broadcast blocks of bounded size, and edges are counted before they
are shuffled. The slots of patterns with enough base entities are filled first; in each round then those of patterns
that have enough base entities and found tokens together. No other pattern can be sure, so that nothing is lost.
Nor can one be sure whose slot holds more distinct tokens than its support allows (a quarter more at most): these are
told by growing parts of the texts and make no edges, so that the graph follows the base entities and found tokens,
not how often usual words meet. Patterns are 64-bit hashes in the graph.

Positions are code points: the pieces between matches and the matches themselves are summed up, once per text.
Patterns use possessive quantifiers and start only where a run starts, so that a long run is scanned once.

Spans are base spans, then contextual ones that overlap none, then secrets that overlap neither.

Defined results: a null text is an empty text; repeated rows give repeated results (and count as one instance); an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.session import stage

#: The kinds in the order listed, and the patterns (with starts and quantifiers that never rescan).
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
#: A name, a sign, and a value of up to 256 characters that white space, a quote, a comma or a bracket ends.
ASSIGNED = r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]*+ ?[=:] ?[\x22']?[^\s\x22',;()<>{}]++"
_VALUE = r"[^\s\x22',;()<>{}=:]++$"
#: Values that look drawn at random: 16 or more letters, digits and signs of usual encodings, digits and letters mixed.
SECRET = r"^(?=(?:[^0-9]*[0-9]){4})(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_-]{16,}$"
_SPACE = r"[\x20\x09-\x0D]"
#: In marked texts a base entity stands between the mark of its kind and the end mark; blanks within it are glued.
_MARKS, _END, _GLUE = "\x01\x02\x03\x04", "\x05", "\x07"
_PUNCTUATION = ".,;:!?()<>[]{}\"'"
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)"
MIN_DIGITS = 4
ROUNDS = 3
CONFIDENT, SUPPORT, SMOOTH = 0.8, 4.0, 1.0
THRESHOLD = 0.8
#: Patterns or instances that are broadcast at once; words of a text whose lengths are added up at once.
BLOCK = 1_000_000
CHUNK = 256
#: One in so many texts is read for the fillers of slots, then one in fewer, then all.
PARTS = (64, 8, 1)


def _sql(s: str) -> str:
    """A string literal that means the same whatever the parser's escape settings: every backslash doubled."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"length(regexp_replace({x}, '[^0-9]', ''))"


def valid(kind: str, x: str) -> str:
    """SQL: whether a match of a kind's pattern passes the kind's checks."""
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{x} rlike {_sql('^' + _OCTET + chr(92) + '.' + _OCTET + chr(92) + '.' + _OCTET + chr(92) + '.' + _OCTET + '$')}"
    if kind == "phone":
        return f"{_digits(x)} between 9 and 15"
    luhn = "aggregate(transform(sequence(1, length(d)), i -> int(substr(d, -i, 1)) * if(i % 2 = 0, 2, 1)), 0, (a, v) -> a + if(v > 9, v - 9, v)) % 10 = 0"
    return f"if({_digits(x)} between 12 and 19, transform(array(regexp_replace({x}, '[^0-9]', '')), d -> {luhn})[0], false)"


def _running_sums(a: str) -> str:
    """SQL: the sums of all beginnings of an array of ints, in chunks, so that no long array is copied for each item."""
    chunks = f"transform(sequence(0, (size(a) - 1) div {CHUNK}), c -> slice(a, c * {CHUNK} + 1, {CHUNK}))"
    fold = "aggregate(x, array({}), (f, y) -> array_append(f, element_at(f, -1) + y))"
    begins = "aggregate(k, array(0), (f, x) -> array_append(f, element_at(f, -1) + aggregate(x, 0, (g, y) -> g + y)))"
    sums = f"flatten(transform(k, (x, c) -> slice({fold.format('b[c]')}, 2, size(x))))"
    return f"transform(array({a}), a -> transform(array({chunks}), k -> transform(array({begins}), b -> {sums})[0])[0])[0]"


def _spans(text: str, pattern: str) -> str:
    """SQL: the matches of a pattern in a text, as (s, e, t)."""
    steps = "transform(m, (x, i) -> length(p[i]) + length(x))"
    pieces = f"transform(array(split({text}, {pattern}, -1)), p -> {_running_sums(steps)})[0]"
    zipped = f"transform(array({pieces}), q -> transform(m, (x, i) -> named_struct('s', q[i] - length(x), 'e', q[i], 't', x)))[0]"
    return f"transform(array(regexp_extract_all({text}, {pattern}, 0)), m -> if(size(m) = 0, cast(array() as array<struct<s:int,e:int,t:string>>), {zipped}))[0]"


def base_spans(kind: str) -> Column:
    """The valid spans of a kind in the column text: array of (s, e, t)."""
    found = _spans("text", _sql(PATTERNS[kind]))
    hint = {"email": "contains(text, '@')", "phone": "contains(text, '+')"}.get(kind, "text rlike '[0-9]'")
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    return F.expr(f"if({hint}, filter({found}, x -> {valid(kind, 'x.t')}), {none})")


def _spans_if(hint: str, pattern: str) -> Column:
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    return F.expr(f"if({hint}, {_spans('text', _sql(pattern))}, {none})")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed; spans: array of (s, k, e)."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def _marked(kind: int) -> str:
    """SQL: the column marked with the valid matches of a kind between marks, and other numbers in groups glued."""
    pattern = PATTERNS[KINDS[kind]]
    glued = f"translate(x, ' ', '{_GLUE}')"
    mark = f"case when {valid(KINDS[kind], 'x')} then concat('{_MARKS[kind]}', {glued}, '{_END}') when {_digits('x')} >= {MIN_DIGITS} then {glued} else x end"
    body = f"concat(array_join(transform(m, (x, i) -> concat(p[i], {mark})), ''), p[size(m)])"
    pieces = f"transform(array(split(marked, {_sql(pattern)}, -1)), p -> {body})[0]"
    hint = {"email": "size(email) > 0", "phone": "contains(marked, '+')"}.get(KINDS[kind], "marked rlike '[0-9]'")
    return f"if({hint}, transform(array(regexp_extract_all(marked, {_sql(pattern)}, 0)), m -> if(size(m) = 0, marked, {pieces}))[0], marked)"


def extract(docs: DataFrame) -> DataFrame:
    """A row per document, staged: doc_id, row, base spans of each kind, and the text with marked base entities."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.translate("text", _MARKS + _END + _GLUE, "\x06" * 6)
    keys = _spans_if("contains(text, 'AKIA')", ACCESS_KEY).alias("access_keys")
    # of an assignment: its place, its name with the sign, and its value
    value = f"regexp_extract(x.t, {_sql(_VALUE)}, 0)"
    parted = f"named_struct('s', x.e - length(v), 'e', x.e, 'name', lower(regexp_replace(left(x.t, length(x.t) - length(v)), '[^A-Za-z0-9_=:-]', '')), 'value', v)"
    assigned = F.expr(f"filter(transform(assigned, x -> transform(array({value}), v -> {parted})[0]), x -> x.value <> '')").alias("assigned")
    df = df.select("doc_id", F.monotonically_increasing_id().alias("row"), *(base_spans(k).alias(k) for k in KINDS), keys, _spans_if("contains(text, '=') or contains(text, ':')", ASSIGNED).alias("assigned"), own.alias("marked"))
    df = df.select("doc_id", "row", *KINDS, "access_keys", assigned, "marked")
    for k in range(len(KINDS)):
        df = df.withColumn("marked", F.expr(_marked(k)))
    return stage(df)


def _bare(x: Column) -> Column:
    """A lower-case token without punctuation at its ends, or the token where nothing else is in it."""
    x = F.lower(x)
    bare = F.btrim(x, F.lit(_PUNCTUATION))
    return F.when(bare != "", bare).otherwise(x)


def _slots(found: DataFrame) -> DataFrame:
    """A row for each word and each of its patterns: t, pattern."""
    zipped = "arrays_zip(w, concat(array(''), w), concat(array('', ''), w), slice(w, 2, size(w)))"
    words = f"split(btrim(lower(marked), ' \t\n\x0b\x0c\r'), {_sql(_SPACE + '++')}, -1)"
    w = found.select(F.expr(f"inline(transform(array({words}), w -> {zipped})[0])").alias("t", "l1", "l2", "r1")).filter("t <> ''")
    left = F.when((F.col("l2") != "") & (F.col("l1") != ""), F.xxhash64(F.lit("L"), "l2", "l1"))
    both = F.when((F.col("l1") != "") & (F.col("r1") != ""), F.xxhash64(F.lit("B"), "l1", "r1"))
    return w.select("t", F.explode(F.array(left, both)).alias("pattern")).filter("pattern is not null")


def _in_blocks(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows joined with keys (staged, each key once), which are broadcast in blocks of bounded size."""
    n = -(-keys.count() // BLOCK) or 1
    out = None
    for b in range(n):
        part = rows.join(F.broadcast(keys.filter(F.pmod(F.hash(key), F.lit(n)) == b)), key)
        out = part if out is None else out.unionByName(part)
    return out


def _fillers(found: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of patterns (pattern, and the support that it has at most; staged) those that so much support can make sure, and
    the distinct edges between them and the tokens in their slots that hold no base entity, staged.

    A part of the texts has no more distinct fillers than all of them, so a pattern that has too many there is left
    before the other texts are looked at. Only the last part, all texts, makes edges."""
    for part in PARTS:
        n = patterns.count()
        rows = found if part == 1 else found.filter(F.pmod(F.xxhash64("row"), F.lit(part)) == 0)
        tokens = _in_blocks(_slots(rows), patterns.select("pattern"), "pattern").filter(f"not t rlike '[{_MARKS}]'")
        fillers = tokens.select("pattern", _bare(F.col("t")).alias("instance"), F.lit(None).cast("int").alias("kind")).distinct()
        if part == 1:
            fillers = stage(fillers)
        over = fillers.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).join(patterns, "pattern").filter(F.col("support") / (F.col("n") + SMOOTH) < CONFIDENT)
        patterns = stage(patterns.join(over.select("pattern"), "pattern", "left_anti"), rows=n)
        if patterns.isEmpty():
            return patterns.select("pattern"), fillers.limit(0)
    return patterns.select("pattern"), stage(fillers.join(patterns, "pattern", "left_semi"))


def graph(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The distinct edges of instances: instance, kind (null if unknown) and patterns (one in each row), staged; all of
    those that can matter within so many rounds."""
    some = found.filter(" + ".join(f"size({k})" for k in KINDS) + " > 0")
    seed = _slots(some).filter(f"t rlike '[{_MARKS}]'").select("pattern", F.explode(F.expr(f"regexp_extract_all(t, '[{_MARKS}][^{_END}]*+', 0)")).alias("x"))
    seeds = stage(seed.select("pattern", F.expr("substr(x, 2)").alias("instance"), (F.ascii("x") - 1).alias("kind")).distinct())
    # a pattern's support is at most its base entities of one kind and the found tokens in its slot; it is sure only with
    # SUPPORT of them, and if they are enough for all that stand in the slot
    held = stage(seeds.groupBy("pattern", "kind").count().groupBy("pattern").agg(F.max("count").alias("held")))
    opened, fillers = _fillers(found, stage(held.select("pattern", F.col("held").alias("support")).filter(F.col("support") >= SUPPORT)))
    edges = stage(seeds.join(opened, "pattern", "left_semi").unionByName(fillers))
    for r in range(1, rounds):
        new = _scores(_graph(edges), r)
        if new is None:
            break
        words = _slots(found).filter(f"not t rlike '[{_MARKS}]'").select("pattern", _bare(F.col("t")).alias("instance"))
        hits = _in_blocks(words, stage(new.select("instance").distinct()), "instance").distinct()
        more = hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("more")).join(held, "pattern").select("pattern", (F.col("held") + F.col("more")).alias("support"))
        more, fillers = _fillers(found, stage(more.filter(F.col("support") >= SUPPORT).join(opened, "pattern", "left_anti")))
        if not more.isEmpty():
            opened, edges = stage(opened.unionByName(more)), stage(edges.unionByName(seeds.join(more, "pattern", "left_semi")).unionByName(fillers))
    return stage(_graph(edges))


def _graph(edges: DataFrame) -> DataFrame:
    return edges.select("instance", "kind", F.array("pattern").alias("patterns"))


def occurrences(found: DataFrame, more: DataFrame) -> DataFrame:
    """row, s, e and k of all tokens that are instances found by their context."""
    plain = f"translate(array_join(x, ' '), '{_MARKS}{_END}', '')"
    chunks = f"transform(sequence(0, (size(w) - 1) div {CHUNK}), c -> slice(w, int(c * {CHUNK} + 1), {CHUNK}))"
    starts = f"aggregate(c, array(0), (a, x) -> array_append(a, element_at(a, -1) + length({plain}) + 1))"
    zipped = f"transform(array({chunks}), c -> arrays_zip(c, slice({starts}, 1, size(c))))[0]"
    parts = found.select("row", F.expr(f"inline(transform(array(split(marked, {_sql(_SPACE)}, -1)), w -> {zipped})[0])").alias("x", "at"))
    words = parts.select("row", "x", "at", F.posexplode("x").alias("i", "t")).filter(f"t <> '' and not t rlike '[{_MARKS}]'").withColumn("instance", _bare(F.col("t")))
    hits = _in_blocks(words, more, "instance")
    before = F.expr(f"at + if(i = 0, 0, transform(array(slice(x, 1, i)), x -> length({plain}) + 1)[0])")
    core = F.btrim("t", F.lit(_PUNCTUATION))
    s = before + F.when(core != "", F.length("t") - F.length(F.ltrim("t", F.lit(_PUNCTUATION)))).otherwise(0)
    return hits.select("row", s.cast("int").alias("s"), (s + F.length(F.when(core != "", core).otherwise(F.col("t")))).cast("int").alias("e"), "k")


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind) of unknown instances that high-confidence patterns find."""
    new = _scores(occurrences, rounds)
    if new is None:
        return occurrences.select("instance", F.col("kind").alias("k")).limit(0)
    best = new.filter(F.col("score") >= THRESHOLD).groupBy("instance").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    return stage(best.select("instance", (-F.col("b.k")).alias("k")))


def _scores(occurrences: DataFrame, rounds: int) -> DataFrame | None:
    """instance, k and score of the unknown instances that are reached after so many rounds, staged; None without any."""
    edges = occurrences.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    seeded = stage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("seeds")).filter(F.col("seeds") >= 1).filter(F.col("n") >= SUPPORT).select("pattern", "n"))
    edges = stage(edges.join(seeded, "pattern"))  # pattern, instance, kind, n
    seeds = edges.filter("kind is not null").select("instance", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct()
    new = None
    for _ in range(rounds):
        # a round's scores replace the last round's: an instance counts once, so that no confidence comes to 1
        scores = seeds if new is None else seeds.unionByName(new)
        weighed = edges.join(stage(scores), "instance").groupBy("pattern", "k").agg(F.sum("score").alias("support"), F.first("n").alias("n"))
        sure = stage(weighed.withColumn("confidence", F.col("support") / (F.col("n") + SMOOTH)).filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern", "k", "confidence"))
        if sure.isEmpty():
            break
        reached = edges.filter("kind is null").join(sure, "pattern").groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))).alias("score"))
        new = stage(reached)
    return new


def secret_slots(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The names that secrets are assigned to: those that the graph of names and values is sure of, staged."""
    pairs = found.filter("size(assigned) > 0").select(F.explode("assigned").alias("x")).select("x.name", "x.value")
    # long values are known by their hash; equal pairs of a task meet before they are shuffled
    edges = pairs.groupBy("name", F.xxhash64("value").alias("value")).agg(F.max(F.col("value").rlike(SECRET).cast("int")).alias("seed"))
    edges = stage(edges)
    n = edges.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("seed").alias("seeds"))
    sure = stage(n.filter((F.col("seeds") >= SUPPORT) & (F.col("seeds") / (F.col("n") + SMOOTH) >= CONFIDENT)).select("name"))
    for _ in range(rounds - 1):
        # values that sure names have are scored by them, and score the other names that they fill
        reached = stage(edges.join(sure, "name", "left_semi").select("value").distinct())
        scored = edges.join(reached.withColumn("found", F.lit(1)), "value", "left").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("seed", F.coalesce("found", F.lit(0)))).alias("support"))
        new = stage(scored.filter((F.col("support") >= SUPPORT) & (F.col("support") / (F.col("n") + SMOOTH) >= CONFIDENT)).select("name"))
        if new.count() == sure.count():
            break
        sure = new
    return sure


def secrets(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row and spans (s, k, e) of the values that stand in slots of secrets."""
    sure = secret_slots(found, rounds)
    each = found.filter("size(assigned) > 0").select("row", F.explode("assigned").alias("x")).select("row", "x.name", "x.s", "x.e")
    return _in_blocks(each, sure, "name").select("row", "s", F.lit(KINDS.index("phone") + 1).alias("k"), "e")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base, contextual ones and secrets),
    n_secret and n_spans (all of them)."""
    found = extract(docs)
    more = bootstrap(graph(found, rounds), rounds)
    spans = F.concat(*(F.expr(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))") for i, k in enumerate(KINDS)))
    keys = F.expr(f"transform(access_keys, x -> named_struct('s', x.s, 'k', {len(KINDS)}, 'e', x.e))")
    out = found.select("doc_id", "row", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), spans.alias("base"), keys.alias("keys"))
    gather = lambda df, name: stage(df.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "k", "e"))).alias(name)))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    if not more.isEmpty():
        out = out.join(gather(occurrences(found, more), "new"), "row", "left")
    else:
        out = out.withColumn("new", none)
    out = out.join(gather(secrets(found, rounds), "assigned"), "row", "left")
    apart = lambda new, have: F.filter(F.coalesce(new, none), lambda x: ~F.exists(have, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
    out = out.withColumn("every", F.concat("base", apart(F.col("new"), F.col("base"))))
    out = out.withColumn("every", F.concat("every", apart(F.col("keys"), F.col("every"))))
    out = out.withColumn("every", F.concat("every", apart(F.col("assigned"), F.col("every"))))
    n_secret = F.size(F.filter("every", lambda x: x["k"] == len(KINDS))).cast("long")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"), n_secret.alias("n_secret"), F.size("every").cast("long").alias("n_spans"))
