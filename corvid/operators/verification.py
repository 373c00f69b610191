"""Citations and verdicts of generated answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions.scalar import WHITE_SPACE, estimated_tokens, xml_escape, xml_unescape

#: Fixed value: a group of citation markers.
MARKERS = r"\[\s*[PS]\d{1,3}(?:\s*,\s*[PS]\d{1,3})*\s*\]"


#: A run of white space in a regular expression.
SPACES = f"[{WHITE_SPACE}]+"


def references(answer: Column) -> Column:
    """References in order of first use."""
    groups = F.regexp_extract_all(answer, F.lit(MARKERS), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"[PS]\d{1,3}"), F.lit(0)))))


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, known, unknown): references of an answer that a passage (answer_id, ref) has, and the others."""
    used = answers.select("answer_id", F.posexplode_outer(references(F.col("answer"))).alias("i", "ref"))  # an answer without markers has empty lists
    found = used.join(passages.select("answer_id", "ref").distinct().withColumn("there", F.lit(True)), ["answer_id", "ref"], "left")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c & F.col("ref").isNotNull(), F.struct("i", "ref")))), lambda x: x["ref"])
    return found.groupBy("answer_id").agg(pick(F.col("there")).alias("known"), pick(F.col("there").isNull()).alias("unknown"))


def verdict(n_claims: Column, n_supported: Column, n_cited: Column, n_cited_support: Column) -> Column:
    """Of a sentence, from its claims: how many, supported by a passage, its citations, claims that a citation supports."""
    return (
        F.when(n_claims == 0, "no_claim").when(n_supported == 0, "unsupported").when(n_supported < n_claims, "partial").when(n_cited == 0, "uncited_supported").when(n_cited_support == n_claims, "supported").otherwise("miscited")
    )


def overall(sentences: DataFrame, strict: bool = False) -> DataFrame:
    """(answer_id, verdict) to counts of verdicts and whether the answer passes."""
    names = ("supported", "partial", "unsupported", "miscited", "uncited_supported", "no_claim")
    out = sentences.groupBy("answer_id").agg(*(F.count_if(F.col("verdict") == n).alias(n) for n in names))
    bad = (F.col("partial") + F.col("unsupported") > 0) | (F.lit(strict) & (F.col("miscited") + F.col("uncited_supported") > 0))
    return out.withColumn("passes", ~bad)


def locate(text: Column, quote: Column) -> Column:
    """struct(start, end): bytes of the text where a quote stands, exactly, else with runs of white space on both sides taken as
    one space; null if it is blank or absent, also after undoing XML escapes."""

    def at(q: Column) -> Column:
        exact = F.instr(text, q)
        found = F.when(exact > 0, q)
        words = F.filter(F.split(F.regexp_replace(q, SPACES, " "), " "), lambda w: w != "")
        pattern = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), SPACES)
        found = F.coalesce(found, F.nullif(F.regexp_substr(text, pattern), F.lit("")))
        start = F.octet_length(F.substring(text, F.lit(1), F.instr(text, found) - 1)).cast("long")
        return F.when(F.size(words) > 0, F.when(found.isNotNull(), F.struct(start.alias("start"), (start + F.octet_length(found)).alias("end"))))

    return F.coalesce(at(quote), at(xml_unescape(quote)))


#: What an experiment needs before its challenger may be promoted.
MIN_SAMPLES, MIN_GAIN = 50, 0.05


def ready_to_promote(samples: Column, champion: Column, challenger: Column, closed: Column | None = None) -> Column:
    """Whether an experiment that is not closed shows enough gain on enough samples; null measures are not ready."""
    ready = F.coalesce((samples >= MIN_SAMPLES) & (challenger > champion + MIN_GAIN), F.lit(False))
    return ready if closed is None else ready & ~F.coalesce(closed, F.lit(False))


#: Characters that close a sentence after its citations.
CLOSING = ".,;:!?。！？，；：)）"
_MARKER, _END = re.compile(MARKERS), re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|$|\[\s*[PS]\d)|[。！？]+")


def units(answer: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is code) in characters: fenced code is one unit, other lines are cut into sentences, and citations that
    follow a sentence, with the punctuation after them, belong to it. Sentence ends are . ! ? before white space, and 。！？."""

    def cut(a: int, b: int, code: bool = False) -> Iterator[tuple[int, int, bool]]:
        piece = answer[a:b]
        if piece.strip():
            a += len(piece) - len(piece.lstrip())
            yield a, a + len(piece.strip()), code

    at, fence = 0, None
    for line in answer.splitlines(keepends=True) if "\r" not in answer and "\x0b" not in answer else re.findall(r"[^\n]*\n|[^\n]+", answer):
        start, at = at, at + len(line)
        if line.lstrip().startswith("```"):
            if fence is not None:
                yield from cut(fence, at, True)
            fence = start if fence is None else None
            continue
        if fence is not None:
            continue
        markers, begin, pos, until = [m.span() for m in _MARKER.finditer(answer, start, at)], start, start, at
        while m := _END.search(answer, pos, until):
            pos = m.end()
            inside = next((y for x, y in markers if x < pos < y), None)
            if inside is not None:  # no sentence ends within a marker
                pos = inside
                continue
            trailing = pos
            while (group := next((g for g in markers if g[0] >= trailing and not answer[trailing : g[0]].strip()), None)) is not None:
                trailing = group[1]
            if trailing > pos:
                while trailing < until and answer[trailing] in CLOSING:
                    trailing += 1
                pos = trailing
            yield from cut(begin, pos)
            begin = pos
        yield from cut(begin, until)
    if fence is not None:
        yield from cut(fence, len(answer), True)


def segment(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer) to (answer_id, unit, start, end, code, text): start and end in bytes of the answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], [[], [], [], [], []]
            for i, answer in enumerate(b.column(1).to_pylist()):
                done = size = 0
                for n, (x, y, code) in enumerate(units(answer or "")):
                    size, done = size + len(answer[done:x].encode()), x
                    ids.append(i)
                    for column, value in zip(out, (n, size, size + len(answer[x:y].encode()), code, answer[x:y])):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))], ["answer_id", "unit", "start", "end", "code", "text"])

    kind = answers.schema["answer_id"].dataType.simpleString()
    return answers.select("answer_id", F.col("answer").cast("string")).mapInArrow(run, f"answer_id {kind}, unit int, start long, end long, code boolean, text string")


def attribute(units_: DataFrame, available: DataFrame) -> DataFrame:
    """Units (answer_id, unit, code, text) with their citations in order, each once: cited (those that ``available``
    (answer_id, ref) has) and invalid. Code has none."""
    refs = units_.select("answer_id", "unit", F.when(F.col("code"), F.array().cast("array<string>")).otherwise(references(F.col("text"))).alias("refs"))
    known = available.groupBy("answer_id").agg(F.collect_set("ref").alias("known"))  # the passages of one answer
    met = refs.join(known, "answer_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return met.select("answer_id", "unit", F.array_intersect("refs", "known").alias("cited"), F.array_except("refs", "known").alias("invalid"))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (passage, chunk, document_id, version_num, start, end, text) to one row a passage: start, end, text, n_chunks,
    error (null, mixed_versions, not_contiguous or text_mismatch; then without text). A passage's chunks are a handful;
    ``start`` and ``end`` are bytes."""
    one = chunks.dropDuplicates(["passage", "chunk"])
    row = F.struct("start", "end", "chunk", F.encode("text", "UTF-8").alias("data"))
    per = one.groupBy("passage").agg(F.array_sort(F.collect_list(row)).alias("c"), F.countDistinct("document_id", "version_num").alias("versions"))
    state = F.struct(F.get("c", F.lit(0))["start"].alias("cursor"), F.lit(None).cast("string").alias("error"), F.lit(b"").alias("data"))

    def step(s: Column, r: Column) -> Column:
        wrong = (r["end"] < r["start"]) | (F.octet_length(r["data"]) != r["end"] - r["start"])
        inside = (r["end"] <= s["cursor"]) & (F.octet_length(s["data"]) > 0)
        more = F.concat(s["data"], F.substring(r["data"], (s["cursor"] - r["start"] + 1).cast("int"), F.octet_length(r["data"])))
        fail = lambda e: F.struct(s["cursor"].alias("cursor"), F.lit(e).alias("error"), s["data"].alias("data"))
        return F.when(s["error"].isNotNull() | (~wrong & inside), s).when(wrong, fail("text_mismatch")).when(r["start"] > s["cursor"], fail("not_contiguous")).otherwise(F.struct(r["end"].alias("cursor"), s["error"].alias("error"), more.alias("data")))

    done = per.withColumn("s", F.aggregate("c", state, step))
    error = F.when(F.col("versions") > 1, "mixed_versions").otherwise(F.col("s.error"))
    return done.select("passage", F.get("c", F.lit(0))["start"].alias("start"), F.when(error.isNull(), F.col("s.cursor")).alias("end"), F.when(error.isNull(), F.decode("s.data", "UTF-8")).alias("text"), F.size("c").alias("n_chunks"), error.alias("error"))


def chunk_at(chunks: DataFrame, offsets: DataFrame) -> DataFrame:
    """offsets (passage, offset) to the chunk (passage, chunk, start, end) that holds it, the first in order; else the first
    chunk of the passage."""
    met = offsets.join(chunks.select("passage", "chunk", "start", "end"), "passage")
    key = F.struct((~((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))).alias("out"), "start", "end", "chunk")
    return met.groupBy("passage", "offset").agg(F.min(key)["chunk"].alias("chunk"))


def plan_batches(sentences: DataFrame, base: Column, max_tokens: int, max_sentences: int) -> DataFrame:
    """sentences (answer_id, unit, cost) with ``batch`` and ``error``: filled in order while tokens (with ``base`` for the
    passages) and number allow; a sentence that alone is too long has a batch of its own; passages beyond the limit are an
    error. Sequential within an answer, whose sentences are one array."""
    rows = sentences.withColumn("base", base).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("unit", F.col("cost").cast("long").alias("cost")))).alias("s"), F.max("base").cast("long").alias("base"))
    kind = "array<struct<unit:int,batch:int>>"
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.col("base").alias("total"), F.array().cast(kind).alias("out"))

    def step(a: Column, r: Column) -> Column:
        full = (a["n"] >= max_sentences) | ((a["n"] > 0) & (a["total"] + r["cost"] > max_tokens))
        batch = a["batch"] + F.when(full, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(a["n"] + 1).alias("n"), (F.when(full, F.col("base")).otherwise(a["total"]) + r["cost"]).alias("total"), F.concat(a["out"], F.array(F.struct(r["unit"].cast("int").alias("unit"), batch.alias("batch")))).alias("out"))

    found = rows.select("answer_id", (F.col("base") > max_tokens).alias("over"), F.inline(F.aggregate("s", state, step)["out"]))
    return found.select("answer_id", "unit", F.when(~F.col("over"), F.col("batch")).alias("batch"), F.when(F.col("over"), "passages_over_budget").alias("error"))


def sentence_fragment(unit: Column, cited: Column, text: Column) -> Column:
    return F.concat(F.lit('<sentence id="'), unit, F.lit('" cited="'), xml_escape(F.array_join(cited, ",")), F.lit('">'), xml_escape(text), F.lit("</sentence>\n"))


JUDGED = "sentences array<struct<id:bigint,kind:string,claims:array<struct<text:string,support:array<struct<ref:string,quote:string>>>>>>"


def extract_json(raw: Column) -> Column:
    """What a reply holds within a code fence, else from its first '{' to its last '}'."""
    t = F.btrim(raw, F.lit(WHITE_SPACE))
    fenced = F.btrim(F.regexp_extract(t, "(?s)^```[^\\n]*\\n(.*?)(?:```)?\\s*$", 1), F.lit(WHITE_SPACE))
    t = F.when(t.startswith("```") & fenced.startswith("{"), fenced).otherwise(t)
    return F.when(t.startswith("{"), t).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, "(?s)[{].*[}]", 0), F.lit("")), t))


def parse_judgement(replies: DataFrame) -> DataFrame:
    """replies (answer_id, batch, raw, truncated, ids array<long>, available array<string>) with ``sentences`` and ``error``, the
    first that applies: truncated, invalid JSON, unknown, duplicate or missing sentences, claims without claims, unknown refs."""
    got = replies.withColumn("j", F.from_json(extract_json(F.col("raw")), JUDGED)["sentences"])
    seen = F.transform("j", lambda x: x["id"])
    supports = F.flatten(F.transform("j", lambda x: F.flatten(F.transform(F.coalesce(x["claims"], F.array()), lambda c: F.coalesce(c["support"], F.array())))))
    kinds = F.forall("j", lambda x: x["id"].isNotNull() & F.coalesce(x["kind"].isin("claim", "no_claim"), F.lit(False)))
    error = (
        F.when(F.col("truncated"), "truncated")
        .when(F.col("j").isNull() | ~kinds, "invalid_json")
        .when(F.size(F.array_except(seen, "ids")) > 0, "unknown_sentence")
        .when(F.size(F.array_distinct(seen)) < F.size(seen), "duplicate_sentence")
        .when(F.size(F.array_except("ids", seen)) > 0, "missing_sentence")
        .when(F.exists("j", lambda x: (x["kind"] == "claim") & (F.size(F.coalesce(x["claims"], F.array())) == 0)), "claim_without_claims")
        .when(F.size(F.array_except(F.transform(supports, lambda x: x["ref"]), "available")) > 0, "unknown_ref")
    )
    return got.withColumn("error", error).withColumn("sentences", F.when(F.col("error").isNull(), F.col("j"))).drop("j")


def token_usage(calls: DataFrame, by: str, *columns: str) -> DataFrame:
    """Sums of each column by ``by``; a sum with a null in it is null."""
    return calls.groupBy(by).agg(*(F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c)).alias(c) for c in columns))


def evidence(claims: DataFrame, registry: DataFrame, versions: DataFrame) -> DataFrame:
    """Chains of proof: claims (root, kind, chunk) over a chunk, tree node, entity or relation, registry rows (chunk,
    document_id, version_num, source_uri, snapshot_uri, page, section, start, end), versions (document_id, version_num, status).

    A row for each chunk that the registry knows: its label and the status of its version ("unknown" without one), and
    ``is_source``: whether it is the first of its root with that snapshot and span."""
    met = claims.join(registry, "chunk").join(versions.select("document_id", "version_num", "status"), ["document_id", "version_num"], "left")
    label = F.concat(F.col("source_uri"), F.lit(" p."), F.coalesce(F.col("page").cast("string"), F.lit("-")), F.lit(" §"), F.coalesce("section", F.lit("-")))
    first = F.row_number().over(Window.partitionBy("root", "snapshot_uri", "start", "end").orderBy("chunk"))
    return met.select("root", "kind", "chunk", label.alias("label"), F.coalesce("status", F.lit("unknown")).alias("version_status"), (first == 1).alias("is_source"))


def judge_cost(text: Column) -> Column:
    return F.greatest(estimated_tokens(text), F.lit(1))


def promote(status: Column) -> Column:
    """Status after promotion, null where it is refused: only an experiment that is ready may be promoted."""
    return F.when(status == "ready_to_promote", "closed")


def measured(status: Column, ready: Column) -> Column:
    """Status after new measures, null where they are refused: a closed experiment takes none."""
    return F.when(status == "closed", F.lit(None)).when(ready, "ready_to_promote").otherwise(status)
