"""Queries opN over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe as bpe_
from tidewright.llm import decontaminate, exact_dedup, html_text, jaccard_join, language_id, license_scan, line_dedup, pii, quality, spelling, toxicity, vector_codes
from tidewright.llm.common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_.bpe(table(spark, sf_dir, "documents"), word_vocabulary())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("line_dedup_n_lines").cast("long").alias("n_lines"),
        F.col("line_dedup_n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_secret", "n_term", (F.expr("n_email + n_ip + n_card + n_phone + n_secret + n_term")).alias("n_spans"), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.grade(docs, model)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.where(~language_id.held_out("doc_id")))
    return language_id.identify(docs, profiles).select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return vector_codes.label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(~toxicity.held_out("doc_id")), labels.where(~toxicity.held_out("doc_id")))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_jaccard_join, op4_decontamination, op5_license_scan, op6_html_text, op7_line_dedup, op8_pii, op9_quality, op10_language_id, op11_vector_codes, op12_spelling, op13_toxicity)}


#: SQL of one assignment of parts x to the entries b of round r, and of the entries that follow from it.
_ASSIGN = """a{r} as (select vec_id, p, arg_min(e, (d, e)) as e, min(d) as d from (
                select vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from x join b{r} on x.p = b{r}.p) group by vec_id, p)"""
_LLOYD = f"""{_ASSIGN},
            m{{r}} as (select p, e, list(mean order by place) as c from (select p, e, place, floor(sum(i) / count(*))::bigint as mean from (
                select a{{r}}.p, e, unnest(x) as i, unnest(range(len(x))) as place from a{{r}} join x on a{{r}}.vec_id = x.vec_id and a{{r}}.p = x.p) group by p, e, place) group by p, e),
            b{{s}} as (select b{{r}}.p, b{{r}}.e, coalesce(m{{r}}.c, b{{r}}.c) as c from b{{r}} left join m{{r}} on b{{r}}.p = m{{r}}.p and b{{r}}.e = m{{r}}.e),"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
            select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
                   row_number() over (partition by norm order by doc_id desc) = 1 as kept, sha256(norm) as text_sha256
            from t""",
        "op7_line_dedup": """
            with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
            l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d where text is not null),
            w as (select doc_id, pos, line as l1, lead(line, 1) over o as l2, lead(line, 2) over o as l3 from l window o as (partition by doc_id order by pos)),
            r as (select doc_id, pos, row_number() over (partition by l1, l2, l3 order by doc_id, pos) as k, count(*) over (partition by l1, l2, l3) as n from w where l3 is not null),
            c as (select doc_id, pos + unnest([0, 1, 2]) as pos, k = 1 as stays from r where n > 1),
            g as (select doc_id, pos from c group by doc_id, pos having not bool_or(stays)),
            s as (select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, string_agg(case when g.pos is null then line end, chr(10) order by l.pos) as kept
                  from l left join g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
            select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as text_sha256
            from d left join s using (doc_id)""",
            "op11_vector_codes": f"""
            with k as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
                       where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            x as (select vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x from k, range(16) t(p)),
            b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from x where vec_id in (select vec_id from k order by vec_id limit 64)),
            {"".join(_LLOYD.format(r=r, s=r + 1) for r in range(2))}
            {_ASSIGN.format(r=2)},
            codes as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a2 group by vec_id),
            book as (select sha256(string_agg(i::varchar, ',' order by p, e, place)) as codebooks_sha256 from (select p, e, unnest(c) as i, unnest(range(len(c))) as place from b2))
            select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from codes join k using (vec_id), book""",
        "op12_spelling": """
            with recursive bits as (select i, i as c, 0 as step from range(256) t(i) union all
                                    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
            crc as (select list(c order by i) as t from bits where step = 8),
            runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
            counted as (select doc_id, run, count(*) as n, hex(encode(doc_id::varchar || ':' || run)) as bytes from runs where length(run) >= 7 group by doc_id, run),
            hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(bytes), 2), lambda k: ('0x' || substr(bytes, k, 2))::bigint)),
                                                      lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) as h from counted, crc),
            w as (select word, sum(n)::bigint as n from (select n, case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
                  where length(word) >= 7 group by word having sum(n) >= 2),
            gone as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from w, unnest(range(length(word))) t(i)),
            near as (select a.word, b.word as other, b.n from gone a join gone b on a.i = b.i and a.rest = b.rest and a.word <> b.word
                     union select a.word, b.word, b.n from gone a join w b on a.rest = b.word union select b.word, a.word, a.n from gone a join w b on a.rest = b.word),
            best as (select word, count(*) as n_near, max(n) as n, arg_min(other, (-n, other)) as other from near group by word),
            forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best.n >= 10 * w.n then other end as form, case when best.n >= 10 * w.n then best.n end as form_n from w left join best using (word)),
            steps as (select word, word as last, 0 as k from forms union all select s.word, f.form, k + 1 from steps s join forms f on s.last = f.word where f.form is not null),
            ends as (select word, arg_max(last, k) as root from steps group by word)
            select word, form, root, n, n_near, form_n from forms join ends using (word)""",
    }
