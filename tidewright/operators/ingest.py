"""Uploads to facts and review queues as one plan: each stage's verdict caps what the next ones may be sure of."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import documents, extract, text
from tidewright.sources.scratch import checkpointed, spread

# Suffixes that are taken and their kinds; the least confidence that needs no review; the confidence of
# holds, of facts of a held document, and of names that are the same person's.
KINDS = {".pdf": "pdf", ".jpg": "image", ".jpeg": "image", ".png": "image", ".docx": "word", ".txt": "text", ".tif": "image", ".tiff": "image"}
THRESHOLD, HELD, MISSING, MISMATCH, SAME_NAME = 0.8, 0.5, 0.4, 0.3, 0.85
MOST_BYTES = 25 << 20


class Ingested(NamedTuple):
    documents: DataFrame  #: upload_id, person_id, case_id, sha256, status, duplicate_of, doc_type, type_confidence, warnings, problems
    facts: DataFrame  #: upload_id, person_id, case_id, field, value, date_value, page, start, end, confidence, notes
    reviews: DataFrame  #: kind, ref, upload_id, titles, confidence


def sniffed(content: Column) -> Column:
    """Kind of a file by its bytes, never by its name: pdf, image, word, text; null if it is none of these.

    Text has no zero byte in its first 4,096, and is UTF-8 with at most two broken characters or Latin-1 of which more
    than 95 % can be printed.
    """
    head, sample = F.hex(F.substring(content, 1, 8)), F.substring(content, 1, 4096)
    is_ = lambda *marks: F.rlike(head, F.lit("^(" + "|".join(marks) + ")"))
    latin, utf8 = F.decode(sample, "ISO-8859-1"), F.make_valid_utf8(sample.cast("string"))
    broken = F.length(utf8) - F.length(F.replace(utf8, F.lit("\ufffd"), F.lit("")))
    printed = F.length(F.regexp_replace(latin, r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]", ""))
    plain = ~F.rlike(latin, F.lit(r"\x00")) & ((broken <= 2) | (printed > 0.95 * F.length(latin)))
    word = is_("504B0304") & F.contains(F.decode(F.substring(content, 1, 65536), "ISO-8859-1"), F.lit("word/"))
    return F.when(is_("25504446"), "pdf").when(is_("89504E47", "FFD8FF", "49492A00", "4D4D002A"), "image").when(word, "word").when(~is_("504B0304") & (F.length(content) > 0) & plain, "text")


def _received(uploads: DataFrame, most_bytes: int) -> DataFrame:
    """Uploads with their plain name, suffix, kind, hash and why they can't be taken, if so."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("filename", F.lit("")), r"\\", "/"), "^.*/", ""))
    u = uploads.withColumn("filename", F.when(name == "", "upload").otherwise(F.substring(name, 1, 200))).withColumn("content", F.coalesce("content", F.lit(b"")))
    u = u.withColumn("_claimed", F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))))
    u = u.withColumn("_kind", sniffed(F.col("content"))).withColumn("sha256", F.sha2("content", 256))
    why = F.when(F.length("content") > most_bytes, "TOO_LARGE").when(F.length("content") == 0, "EMPTY").when(F.col("_claimed").isNull(), "UNSUPPORTED").when(F.col("_kind").isNull(), "UNREADABLE")
    return u.withColumn("_rejected", why)


def _names_known(read: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """(upload_id, named, known): whether an upload names anyone, and whether one of them is its person by any of the
    person's names. Each side is as long as the names of one document and of one person."""
    said = facts.where("field = 'accused'").select("upload_id", extract.person(F.col("value"))["name"].alias("name")).where("name is not null")
    # the Python function stands in a column of its own, as the key is built by lambdas
    said = said.withColumn("_latin", text.to_latin("name")).select("upload_id", text.phonetic_key(F.col("_latin")).alias("k")).where("k <> ''").distinct()
    owner = read.where("person_id is not null").select("upload_id", "person_id")
    known = names.withColumn("_latin", text.to_latin("name")).select("person_id", text.phonetic_key(F.col("_latin")).alias("own")).where("own <> ''").distinct()
    pairs = said.join(owner, "upload_id").join(known, "person_id", "left").withColumn("near", text.jaro_winkler("k", F.coalesce("own", F.lit(""))))
    return pairs.groupBy("upload_id").agg((F.coalesce(F.max("near"), F.lit(0.0)) >= SAME_NAME).alias("known"))


def _cases_of(read: DataFrame, facts: DataFrame, cases: DataFrame) -> DataFrame:
    """(upload_id, mismatch, linked): whether the case that an upload was filed under has another number, and which of
    its person's cases its numbers name, where only one fits and none was given."""
    ref = facts.where("field in ('fir_number', 'cnr')").select("upload_id", "field", text.reference_key(F.col("value")).alias("ref")).where("ref <> ''")
    refs = ref.groupBy("upload_id").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("ref"))).alias(n) for f, n in (("fir_number", "firs"), ("cnr", "cnrs"))])
    own = cases.select("case_id", F.col("person_id").alias("_owner"), *[F.nullif(text.reference_key(F.col(c)), F.lit("")).alias(f"_{c}") for c in ("fir_number", "cnr")])
    differs = lambda c, found: F.coalesce((F.size(found) > 0) & ~F.array_contains(found, F.col(f"_{c}")), F.lit(False))
    filed = read.join(refs, "upload_id").join(own, "case_id").select("upload_id", F.when(differs("cnr", "cnrs"), "cnr").when(differs("fir_number", "firs"), "fir_number").alias("mismatch"))
    fits = lambda c, found: F.coalesce(F.array_contains(found, F.col(f"_{c}")), F.lit(False))
    open_ = read.where("case_id is null and person_id is not null").join(refs, "upload_id").join(own.withColumnRenamed("case_id", "_case"), F.col("person_id") == F.col("_owner"))
    # a person with one case has nothing to be told apart
    linked = open_.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(fits("cnr", "cnrs") | fits("fir_number", "firs"), F.col("_case"))).alias("hits"))
    return filed.where("mismatch is not null").select("upload_id", "mismatch", F.lit(None).cast(cases.schema["case_id"].dataType).alias("linked")).unionByName(linked.where("n > 1 and size(hits) = 1").select("upload_id", F.lit(None).cast("string").alias("mismatch"), F.col("hits")[0].alias("linked")))


def ingest(uploads: DataFrame, names: DataFrame, cases: DataFrame, today: Column, most_bytes: int = MOST_BYTES, head: int | None = 3000) -> Ingested:
    """Documents, facts and reviews of uploads (upload_id, person_id, case_id, filename, content, confidences).

    names: (person_id, name), a row for each name a person is known by; cases: (case_id, person_id, fir_number, cnr).
    `confidences` are those of the reading, page by page (pages end at a form feed; null or too few: 1).

    Rejected are empty, too large, unsupported and unreadable files. Of the same bytes for the same person the first
    upload (by id) is read, the others are duplicates of it. Only text is read here: other kinds come without text. A
    document is held (needs_review) if it has no text, if its class isn't established, if it lacks fields that its class
    must hold, if its numbers are another case's or its names another person's. Facts of a held document stay, with
    confidence at most 0.5 and a note; facts of a badly read page are at most 0.1 surer than its reading. Reviews of one
    kind and reference are one, with all titles and the least confidence. Null ids of person and case mean none.
    """
    # files are dealt to all tasks, hashed and sniffed once
    u = checkpointed(_received(spread(uploads), most_bytes))
    first = u.where("_rejected is null").groupBy("sha256", "person_id").agg(F.min("upload_id").alias("_first"))
    u = u.alias("u").join(first.alias("f"), (F.col("u.sha256") == F.col("f.sha256")) & F.col("u.person_id").eqNullSafe(F.col("f.person_id")) & F.col("u._rejected").isNull(), "left").select("u.*", "f._first")
    dup = F.when(F.col("_first") < F.col("upload_id"), F.col("_first"))
    u = u.withColumn("duplicate_of", dup).withColumn("_text", F.when(F.col("_kind") == "text", F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))).otherwise("")).drop("content", "_first")
    u = u.withColumn("_readable", F.col("_rejected").isNull() & F.col("duplicate_of").isNull() & F.rlike("_text", F.lit(r"(?U)\S")))
    u = u.withColumn("_pages", F.transform(F.split("_text", "\f"), lambda p: F.length(p)))
    u = checkpointed(u.withColumn("_class", F.when(F.col("_readable"), documents.document_class(F.col("_text"), head=head))))
    read = u.where("_readable")

    # every fact with its page; what a labelled field means for the class it must support
    labelled = extract.labelled_fields(read, "upload_id", "_text", today).select("upload_id", "field", "value", "date_value", "start", "end", "confidence")
    charged = read.select("upload_id", F.explode(extract.charges_in("_text")).alias("c")).select("upload_id", F.lit("charge").alias("field"), F.concat_ws(" ", "c.act", "c.section").alias("value"), F.lit(None).cast("date").alias("date_value"), "c.start", "c.end", "c.confidence")
    heard = extract.hearings(read, "upload_id", "_text", today).select("upload_id", F.lit("hearing").alias("field"), F.col("reason").alias("value"), F.col("date").alias("date_value"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "confidence")
    facts = checkpointed(labelled.unionByName(charged).unionByName(heard))

    fields = facts.select("upload_id", F.when(F.col("field") == "accused", "person").otherwise(F.col("field")).alias("field")).groupBy("upload_id").agg(F.collect_set("field").alias("_fields"))
    v = read.select("upload_id", "person_id", "case_id", "filename", "_class", "_claimed", "_kind", "sha256").join(fields, "upload_id", "left").join(_cases_of(read, facts, cases), "upload_id", "left").join(_names_known(read, facts, names), "upload_id", "left")
    kind, sure = F.col("_class.label"), F.col("_class.confidence")
    v = v.withColumn("_lacks", documents.missing_fields(kind, F.coalesce("_fields", F.array().cast("array<string>")))).withColumn("_stranger", F.col("known").isNotNull() & ~F.coalesce("known", F.lit(True)))
    problems = F.array_compact(F.array(F.when((kind == "unknown") | (sure < THRESHOLD), "TYPE_NOT_ESTABLISHED"), F.when(F.size("_lacks") > 0, "CONTENT_INCOMPLETE"), F.when(F.col("mismatch").isNotNull(), "CASE_MISMATCH"), F.when(F.col("_stranger"), "NAME_MISMATCH")))
    v = v.withColumn("problems", problems).withColumn("case_id", F.coalesce("case_id", "linked"))
    v = checkpointed(v.withColumns({"doc_type": kind, "type_confidence": sure}).drop("_class", "_fields", "known"))

    rest = u.join(v.select("upload_id", F.col("case_id").alias("_linked"), "doc_type", "type_confidence", "problems"), "upload_id", "left")
    status = F.when(F.col("_rejected").isNotNull(), "rejected").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("problems").isNull() | (F.size("problems") > 0), "needs_review").otherwise("extracted")
    none = F.array().cast("array<string>")
    problems = F.when(F.col("_rejected").isNotNull(), F.array("_rejected")).when(F.col("duplicate_of").isNotNull(), none).otherwise(F.coalesce("problems", F.array(F.lit("NO_TEXT"))))
    warnings = F.array_compact(F.array(F.when(F.col("_rejected").isNull() & (F.col("_kind") != F.col("_claimed")), "EXTENSION_MISMATCH")))
    out = rest.select("upload_id", "person_id", F.coalesce("_linked", "case_id").alias("case_id"), "filename", "sha256", status.alias("status"), "duplicate_of", "doc_type", "type_confidence", warnings.alias("warnings"), problems.alias("problems"))

    # a fact is as sure as its page was read, and no surer than the document that holds it
    # pages that end before it are counted by their lengths, so that texts aren't shuffled
    at = F.coalesce("start", F.lit(0))
    ended = lambda x, n: F.struct((x["at"] + n + 1).alias("at"), (x["n"] + (x["at"] + n < at).cast("int")).alias("n"))
    page = F.aggregate("_pages", F.struct(F.lit(0).alias("at"), F.lit(1).alias("n")), ended, lambda x: x["n"])
    paged = facts.join(read.select("upload_id", "_pages", "confidences"), "upload_id").withColumn("page", page)
    reading = F.coalesce(F.get("confidences", F.col("page") - 1), F.lit(1.0))
    known = paged.select("upload_id", "field", "value", "date_value", "page", "start", "end", F.when(reading < 0.9, F.least("confidence", reading + 0.1)).otherwise(F.col("confidence")).alias("_c")).join(v.select("upload_id", "person_id", "case_id", "problems"), "upload_id")
    held = F.size("problems") > 0
    kept = known.select(
        "upload_id", "person_id", "case_id", "field", "value", "date_value", "page", "start", "end", F.round(F.when(held, F.least("_c", F.lit(HELD))).otherwise(F.col("_c")), 2).alias("confidence"),
        F.when(held, F.array(F.concat(F.lit("UNVERIFIED_DOCUMENT: "), F.array_join("problems", "; ")))).otherwise(none).alias("notes"),
    )

    ref = F.col("upload_id").cast("string")
    item = lambda df, what, at, title, c: df.select(F.lit(what).alias("kind"), at.alias("ref"), "upload_id", title.alias("title"), c.cast("double").alias("confidence"))
    has = lambda p: v.where(F.array_contains("problems", p))
    reviews = [
        item(out.where("status = 'needs_review' and doc_type is null"), "document", ref, F.lit("NO_TEXT"), F.lit(0.0)),
        item(v.where(F.col("type_confidence") < THRESHOLD), "document_type", ref, F.concat(F.lit("TYPE_NOT_ESTABLISHED: "), "doc_type"), F.col("type_confidence")),
        item(has("CONTENT_INCOMPLETE").where("doc_type <> 'unknown'"), "document_type", ref, F.concat(F.lit("CONTENT_INCOMPLETE: "), F.array_join("_lacks", ", ")), F.least("type_confidence", F.lit(MISSING))),
        item(has("CASE_MISMATCH"), "document_mismatch", ref, F.concat(F.lit("CASE_MISMATCH: "), "mismatch"), F.lit(MISMATCH)),
        item(has("NAME_MISMATCH"), "document_mismatch", ref, F.lit("NAME_MISMATCH"), F.lit(MISMATCH)),
        item(kept.where((F.size("notes") == 0) & (F.col("confidence") < THRESHOLD)), "extraction", F.concat_ws(":", ref, "field", F.coalesce("start", F.lit(-1)).cast("string"), F.coalesce(F.col("date_value").cast("string"), F.lit(""))), F.col("field"), F.col("confidence")),
    ]
    queue = reviews[0]
    for r in reviews[1:]:
        queue = queue.unionByName(r)
    merged = queue.groupBy("kind", "ref", "upload_id").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.min("confidence").alias("confidence"))
    return Ingested(out, kept, merged)
