"""Secret scans, by DataFrame functions alone.

Three rules find assignments, access keys and hexadecimal runs. Two character Markov models, of random
strings and of ordinary identifiers, trained on labelled samples, add the strings of other shapes: a
run of key characters is a secret if its log-likelihood ratio under the two, summed over all its
transitions, reaches a margin. labelled() makes samples of a corpus itself: what the rules find, and the
identifiers of the texts around it.

Where a match lies follows from splitting the text by the rule: a match starts after all pieces and
matches before it. Their lengths are summed in blocks, so the work grows with a text's length and its
number of matches, also for texts with many thousands of them. Offsets are code points, ends
exclusive. `markov` spans may overlap those of rules, which stay as they are.

Nulls: a null text is an empty one and has no spans. Equal texts have equal spans, repeated rows
each have a row. Training samples without one of the classes add no spans. An empty table gives no
rows. redact() keeps all other columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petroloom.llm import shared

# The rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs that the Markov models judge: those of 8 key characters and more that hold a digit or a capital after a
#: small letter, and all of 20 and more; margin and length decide. What is left out are plain words.
_KEY = "[A-Za-z0-9+/_=-]"
RUN = rf"(?<!{_KEY})(?:(?={_KEY}*[0-9])|(?={_KEY}*[a-z][A-Z])|(?={_KEY}{{20}})){_KEY}{{8,}}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 8

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
START = len(ALPHABET)  # the state before the first character
MARGIN = 12.0  # log-likelihood ratio from which a run is a secret
SCALE = 1000
SAMPLE = 2000  # documents with finds of the rules, and others, that the models are trained on, at most
BACKED = 20.0
LEAST_NAME = 5  # characters of an ordinary identifier
REDACTED = "<secret>"
_BLOCK = 256
_SPANS = "array<struct<s:bigint,e:bigint>>"


def _sums(lengths: str) -> Column:
    """Spans from an array of (p, l): the lengths of the piece before each match and of the match."""
    inner = f"""aggregate(c, struct(0L AS pos, cast(array() AS {_SPANS}) AS out),
        (a, x) -> struct(a.pos + x.p + x.l AS pos, array_append(a.out, struct(a.pos + x.p AS s, a.pos + x.p + x.l AS e)) AS out))"""
    chunks = f"transform(sequence(0, (size({lengths}) - 1) div {_BLOCK}), b -> slice({lengths}, b * {_BLOCK} + 1, {_BLOCK}))"
    return F.expr(f"""CASE WHEN size({lengths}) = 0 THEN cast(array() AS {_SPANS}) ELSE flatten(aggregate(transform({chunks}, c -> {inner}),
        struct(0L AS pos, cast(array() AS array<{_SPANS}>) AS out),
        (a, b) -> struct(a.pos + b.pos AS pos, array_append(a.out, transform(b.out, x -> struct(a.pos + x.s AS s, a.pos + x.e AS e))) AS out),
        a -> a.out)) END""")


def _matches(df: DataFrame, kind: str, rule: str, value: int = 0) -> DataFrame:
    """Adds _s_<kind>_at, the spans of a rule, and _s_<kind>_text, the matches (or a group's text)."""
    r, none = F.lit(rule), F.array().cast("array<string>")
    has = F.col("_s_text").rlike(rule)
    if kind == "assign":
        has = (F.contains("_s_text", F.lit("=")) | F.contains("_s_text", F.lit(":"))) & has
    elif kind == "access":
        has = F.contains("_s_text", F.lit("AKIA")) & has
    df = df.withColumn("_s_has", F.coalesce(has, F.lit(False)))
    df = df.withColumn("_s_whole", F.when(F.col("_s_has"), F.regexp_extract_all("_s_text", r, F.lit(0))).otherwise(none))
    df = df.withColumn("_s_pieces", F.when(F.col("_s_has"), F.split("_s_text", rule, -1)).otherwise(none))
    df = df.withColumn("_s_lengths", F.expr("zip_with(slice(_s_pieces, 1, size(_s_whole)), _s_whole, (p, m) -> struct(cast(length(p) AS bigint) AS p, cast(length(m) AS bigint) AS l))"))
    df = df.withColumn(f"_s_{kind}_at", _sums("_s_lengths"))
    df = df.withColumn(f"_s_{kind}_text", F.when(F.col("_s_has"), F.regexp_extract_all("_s_text", r, F.lit(value))).otherwise(none) if value else F.col("_s_whole"))
    return df.drop("_s_has", "_s_whole", "_s_pieces", "_s_lengths")


def _codes(token: str) -> str:
    """SQL: the alphabet positions of a string's characters."""
    return f"transform(split({token}, ''), c -> locate(c, '{ALPHABET}') - 1)"


class Model:
    """table[a * n + b]: the log ratio of random to ordinary for character b after a, times SCALE. counts:
    transitions by (label, a, b). What follows a character leans on what is frequent at all, as if it had
    been seen BACKED times, since samples are small."""

    def __init__(self, counts: dict[tuple[int, int, int], int]) -> None:
        n = len(ALPHABET)
        self.empty = len({label for label, _, _ in counts}) < 2
        chances = []
        for label in (0, 1):
            single = [0.5] * n
            follow = [[0.0] * n for _ in range(n + 1)]
            for (k, a, b), times in counts.items():
                if k == label:
                    single[b] += times
                    follow[a][b] += times
            share = [x / sum(single) for x in single]
            chances.append([(row[b] + BACKED * share[b]) / (sum(row) + BACKED) for row in follow for b in range(n)])
        self.table = [round(SCALE * (math.log(y) - math.log(x))) for x, y in zip(*chances, strict=True)]

    def ratio(self, token: str) -> str:
        """SQL: the log-likelihood ratio of a string of the alphabet, times SCALE: the sum over all its
        transitions, the one from the start included."""
        if self.empty:
            return f"cast(-{10**9} AS bigint)"
        table = f"cast(split('{','.join(map(str, self.table))}', ',') AS array<int>)"
        steps = f"zip_with(concat(array({START}), slice(u, 1, size(u) - 1)), u, (a, b) -> a * {len(ALPHABET)} + b)"
        return f"element_at(transform(array({_codes(token)}), u -> aggregate({steps}, 0L, (sum, k) -> sum + element_at({table}, k + 1))), 1)"


def train(samples: DataFrame) -> Model:
    """samples: label (1 random, 0 ordinary) and token; a token's characters outside the alphabet end it."""
    parts = samples.filter("label IS NOT NULL AND token IS NOT NULL").select("label", F.explode(F.split("token", "[^A-Za-z0-9+/_=-]+")).alias("token")).filter("token != ''")
    steps = parts.select("label", F.expr(_codes("token")).alias("_s_to"))
    pairs = steps.select("label", F.explode(F.expr(f"zip_with(concat(array({START}), slice(_s_to, 1, size(_s_to) - 1)), _s_to, (a, b) -> struct(a, b))")).alias("x"))
    counts = pairs.groupBy("label", F.col("x.a").alias("a"), F.col("x.b").alias("b")).count().collect()  # at most two for each pair of characters
    return Model({(r["label"], r["a"], r["b"]): r["count"] for r in counts})


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Samples to train on: what the rules find in at most `sample` documents, as secrets, and the
    identifiers in the rest of these and of as many other documents, as ordinary."""
    texts = docs.select("doc_id", F.col("text").alias("_s_text"))
    held = F.contains("_s_text", F.lit("=")) | F.contains("_s_text", F.lit(":"))
    has = (held & F.col("_s_text").rlike(ASSIGN)) | (F.contains("_s_text", F.lit("AKIA")) & F.col("_s_text").rlike(ACCESS)) | F.col("_s_text").rlike(HEX)
    ids = shared.materialize(texts.filter("doc_id IS NOT NULL AND _s_text IS NOT NULL").groupBy("doc_id").agg(F.max(has).alias("has")), "found")
    few = [shared.bounded_rows(ids.filter(f), "doc_id", sample).select("doc_id") for f in ("has", "NOT has")]
    few = shared.materialize(few[0].unionByName(few[1]), "few")
    df = texts.join(F.broadcast(few), "doc_id").filter("_s_text IS NOT NULL")
    for kind, rule, value in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)):
        df = _matches(df, kind, rule, value)
    found = df.select(F.lit(1).alias("label"), F.explode(F.concat(F.filter("_s_assign_text", lambda v: F.length(v) >= LEAST_VALUE), "_s_access_text", "_s_hex_text")).alias("token"))
    rest = F.col("_s_text")
    for rule in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, rule, " ")
    names = df.select(F.lit(0).alias("label"), F.explode(F.filter(F.split(rest, "[^A-Za-z0-9+/_=-]+"), lambda w: F.length(w) >= LEAST_NAME)).alias("token"))
    return found.unionByName(names)


def scan(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """docs (doc_id, text): doc_id and for each kind an array of spans (s, e)."""
    df = docs.select("doc_id", shared.empty_if_null().alias("_s_text"))
    df = _matches(df, "assign", ASSIGN, 2)
    df = _matches(df, "access", ACCESS)
    df = _matches(df, "hex", HEX)
    df = _matches(df, "markov", RUN)
    pick = lambda kind, of, test: F.expr(f"filter(zip_with(_s_{kind}_at, {of}, (x, v) -> IF({test}, x, NULL)), x -> x IS NOT NULL)")
    return df.select("doc_id", pick("assign", "_s_assign_text", f"length(v) >= {LEAST_VALUE}").alias("assign"), F.col("_s_access_at").alias("access"), F.col("_s_hex_at").alias("hex"), pick("markov", f"transform(_s_markov_text, v -> {model.ratio('v')})", f"v >= {round(margin * SCALE)}").alias("markov"))


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start and then by kind."""
    each = ", ".join(f"transform({k}, x -> struct(x.s AS s, {i} AS k, x.e AS e))" for i, k in enumerate(KINDS) if k in kinds)
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort(concat({each})), x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """docs with every secret of `text` replaced, and n_chars (if there is one) counted anew."""
    frame, back = shared.set_aside(docs, ["text", "n_chars"])
    df = frame.withColumn("_s_text", F.col("text"))
    swap = f"'{REDACTED}'"
    for rule, part, test in ((ASSIGN, 2, f"length(v) >= {LEAST_VALUE}"), (ACCESS, 0, "true"), (HEX, 0, "true"), (RUN, 0, f"{model.ratio('v')} >= {round(margin * SCALE)}")):
        has = F.coalesce(F.col("_s_text").rlike(rule), F.lit(False))
        df = df.withColumn("_s_has", has).withColumn("_s_whole", F.when(F.col("_s_has"), F.regexp_extract_all("_s_text", F.lit(rule), F.lit(0)))).withColumn("_s_part", F.when(F.col("_s_has"), F.regexp_extract_all("_s_text", F.lit(rule), F.lit(part)))).withColumn("_s_pieces", F.when(F.col("_s_has"), F.split("_s_text", rule, -1)))
        filled = F.expr(f"array_join(zip_with(_s_pieces, concat(zip_with(_s_whole, _s_part, (m, v) -> IF({test}, {swap}, m)), array('')), (p, m) -> concat(p, m)), '')")
        df = df.withColumn("_s_text", F.when(F.col("_s_has"), filled).otherwise(F.col("_s_text"))).drop("_s_has", "_s_whole", "_s_part", "_s_pieces")
    if "n_chars" in frame.columns:
        df = df.withColumn("n_chars", F.when(F.col("_s_text").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("_s_text").cast(frame.schema["n_chars"].dataType)))
    return back(df.withColumn("text", F.col("_s_text")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and a digest of the rules' spans, and the list of all spans."""
    docs = shared.table(spark, sf_dir, "documents")
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(labelled(docs)))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), count("markov"))
