"""Registered queries of the engine's own operators and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import labels, text, vectors
from vectrail.functions.encoders import EncoderSpec
from vectrail.operators import analysis, classify, coupling, gate, knn, relational
from vectrail.plans import jobs
from vectrail.sources import index_store, tables
from vectrail.sources.scratch import folder
from vectrail.streaming import registry_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Raw intents: templated sentences over the part table.
def raw_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    sentence = (
        F.when(key % 5 == 0, F.concat(F.lit("show {Ort} for "), F.col("p_name")))
        .when(key % 5 == 1, "play {track_name} by { Nombre } and {genre}")
        .when(key % 5 == 2, F.col("p_name"))
        .when(key % 5 == 3, "  ")
        .otherwise("count {faces} things of {odd Slot}")
    )
    label = F.concat(F.when(key % 7 == 0, F.lit("  ")).otherwise(F.lit("")), F.lower("p_type"), F.repeat(F.lit(".intent"), (key % 3).cast("int")), F.lit(" "))
    lang = F.when(key % 3 == 0, "en-US").when(key % 3 == 1, "de").otherwise(F.lit(None))
    return part.select("p_partkey", F.when(key % 11 != 0, label).alias("label"), lang.alias("lang"), sentence.alias("sentence"))


RAW = """raw as (select p_partkey, case when p_partkey % 11 <> 0 then (case when p_partkey % 7 = 0 then '  ' else '' end) || lower(p_type) || repeat('.intent', (p_partkey % 3)::int) || ' ' end as label,
  case p_partkey % 3 when 0 then 'en-US' when 1 then 'de' end as lang,
  case p_partkey % 5 when 0 then 'show {Ort} for ' || p_name when 1 then 'play {track_name} by { Nombre } and {genre}' when 2 then p_name when 3 then '  ' else 'count {faces} things of {odd Slot}' end as sentence from part)"""
PLACES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in text.PLACEHOLDERS.items()) + "}"
NAMED = rf"list_transform(regexp_extract_all(sentence, '\{{([^}}]+)\}}', 1), lambda m: coalesce({PLACES}[lower(trim(m))], lower(trim(m))))"


@query(rf"with {RAW} select p_partkey, regexp_replace(trim(label), '(\.intent)+$', '') || '.intent' as label from raw")
def label_normalize(spark, sf):
    return raw_intents(spark, sf).select("p_partkey", labels.normalize_label(F.col("label")).alias("label"))


@query(rf"with {RAW}, n as (select p_partkey, {NAMED} as e from raw) select p_partkey, case when len(e) > 0 then array_to_string(e, ',') end as entity from n")
def entity_extract(spark, sf):
    return raw_intents(spark, sf).select("p_partkey", text.entity(F.col("sentence")).alias("entity"))


@query(rf"with {RAW}, s as (select p_partkey, regexp_replace(regexp_replace(sentence, '\{{[^}}]+\}}', '', 'g'), '^\s+|\s+$', '', 'g') as sentence from raw) select * from s where length(sentence) > 0")
def placeholder_strip(spark, sf):
    return raw_intents(spark, sf).select("p_partkey", text.strip_slots(F.col("sentence")).alias("sentence")).where(F.length("sentence") > 0)


GENRES = "[" + ", ".join(f"'{g}'" for g in text.GENRES) + "]"


@query(
    f"select p_partkey, 'play ' || list_extract({GENRES}, ('0x' || substr(md5(md5(p_partkey::varchar) || '|0|genre'), 1, 7))::int % 10 + 1)"
    " || ' at ' || (('0x' || substr(md5(md5(p_partkey::varchar) || '|1|n'), 1, 7))::int % 100 + 1)::varchar || '!' as sentence from part"
)
def slot_fill(spark, sf):
    seed = F.md5(F.col("p_partkey").cast("string"))
    filled = text.fill_slots(F.lit("play {Genre} at {faces}!"), F.lit("a:b"), F.lit("en"), seed)
    return read(spark, sf, "part").select("p_partkey", filled.alias("sentence"))


@query(rf"with {RAW} select p_partkey, label, sentence from raw where label is not null and sentence is not null and trim(label) <> '' and trim(sentence) <> ''")
def clean_dropna(spark, sf):
    return relational.cleaned(raw_intents(spark, sf), ["label", "sentence"]).select("p_partkey", "label", "sentence")


@query(rf"with {RAW} select count(*) as n_before, count(*) filter (where label is not null and trim(sentence) <> '') as n_after, count(*) - count(*) filter (where label is not null and trim(sentence) <> '') as n_removed from raw")
def removed_rows(spark, sf):
    raw = raw_intents(spark, sf)
    return jobs.removed(raw, relational.cleaned(raw, ["label", "sentence"]))


@query(rf"""with {RAW}, c as (select * from raw where label is not null and trim(sentence) <> ''),
 e as (select *, {NAMED} as names from c)
 select p_partkey, regexp_replace(trim(label), '(\.intent)+$', '') || '.intent' as label, lang, case when len(names) > 0 then array_to_string(names, ',') end as entity, sentence as original_sentence from e""")
def preprocess_job(spark, sf):
    return jobs.preprocess(raw_intents(spark, sf)).select("p_partkey", "label", "lang", "entity", "original_sentence")


@query()
def preprocess_filled(spark, sf):
    return jobs.preprocess(raw_intents(spark, sf))


@query()
def faker_variants(spark, sf):
    return jobs.variants(jobs.preprocess(raw_intents(spark, sf)), 10)


@query(r"select conv_id, turn, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '^[\d\-\.\*]+\s*', ''))[1:3] as lines from conversations")
def llm_output_lines(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", text.cleaned_lines(F.col("text"), 3).alias("lines"))


@query("select item_id, 'task: search result | query: ' || text as query, 'title: none | text: ' || text as document from benchmark")
def query_prefix(spark, sf):
    own = read(spark, sf, "benchmark")
    return own.select("item_id", F.concat(F.lit(text.QUERY_PREFIX), "text").alias("query"), F.concat(F.lit(text.DOCUMENT_PREFIX), "text").alias("document"))


@query("select doc_id, lang from documents where lang in ('en', 'fr')")
def lang_filter(spark, sf):
    return relational.in_languages(read(spark, sf, "documents"), ("en", "fr")).select("doc_id", "lang")


@query("select doc_id, source from documents where source in (select source from documents group by source having count(*) >= 40)")
def min_count_filter(spark, sf):
    return relational.at_least(read(spark, sf, "documents"), "source", 40).select("doc_id", "source")


@query("select source, count(*) as n from documents group by source")
def label_counts(spark, sf):
    return relational.counts(read(spark, sf, "documents"), "source")


@query("select count(distinct source) as n_sources, count(distinct lang) as n_langs from documents")
def unique_counts(spark, sf):
    return read(spark, sf, "documents").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"))


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), "quality", F.lit(":t"), "toxic", F.lit(":s"), (F.col("doc_id") % 3).cast("string")).alias("label"))


HIER = "h as (select doc_id, 'q' || quality || ':t' || toxic || ':s' || (doc_id % 3) as label from labels)"


@query(f"with {HIER} select doc_id, split_part(label, ':', 1) as domain, split_part(label, ':', 2) as intent, split_part(label, ':', 1) || ':' || split_part(label, ':', 2) as composed from h")
def label_split(spark, sf):
    own = hierarchy(spark, sf)
    d, i = labels.part(F.col("label"), 0), labels.part(F.col("label"), 1)
    return own.select("doc_id", d.alias("domain"), i.alias("intent"), labels.compose(d, i).alias("composed"))


@query(f"with {HIER} select doc_id, split_part(label, ':', 1) as l1, array_to_string(string_split(label, ':')[1:2], ':') as l2, label as l3, array_to_string(string_split(label, ':')[1:2], ':') as parent from h")
def hierarchy_levels(spark, sf):
    c = F.col("label")
    return hierarchy(spark, sf).select("doc_id", *[labels.level_class(c, n).alias(f"l{n}") for n in (1, 2, 3)], labels.parent(c).alias("parent"))


@query(f"""with {HIER}, n as (select 1 as level, split_part(label, ':', 1) as class_name, null as parent from h
 union select 2, array_to_string(string_split(label, ':')[1:2], ':'), split_part(label, ':', 1) from h
 union select 3, label, array_to_string(string_split(label, ':')[1:2], ':') from h)
 select level, class_name, parent, dense_rank() over (partition by level order by class_name) - 1 as class_id from n""")
def class_dim(spark, sf):
    return labels.class_dim(hierarchy(spark, sf), "label", 3)


BAG = r"list_sort(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')))"


@query(f"with b as (select doc_id, source, text, {BAG} as bag from documents), r as (select *, row_number() over (partition by source, bag order by length(text) desc, doc_id) as k, min(doc_id) over (partition by source, bag) as first_seq from b) select doc_id, source, first_seq from r where k = 1")
def wordbag_dedup(spark, sf):
    return relational.word_bag_distinct(read(spark, sf, "documents"), "text", "doc_id", ["source"]).select("doc_id", "source", "first_seq")


@query(f"with b as (select source, {BAG} as bag from documents) select source, count(distinct bag) as n_deduped from b group by source")
def wordbag_count(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(F.countDistinct(text.word_bag(F.col("text"))).alias("n_deduped"))


@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as k from documents) where k = 1")
def exact_dedup(spark, sf):
    return relational.first_of(read(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("with c as (select lang, count(*) as n from documents group by lang) select doc_id, n as label_count, case when n >= 500 then 'medoids' when n > 140 then 'sample' when n < 110 then 'augment' else 'keep' end as tier from documents join c using (lang)")
def tier_route(spark, sf):
    return relational.routed(read(spark, sf, "documents"), "lang", huge=500, large=140, small=110).select("doc_id", "label_count", "tier")


@query("""with s as (select doc_id, source, lang, count(*) over (partition by source) as n, count(*) over (partition by source, lang) as m,
 row_number() over (partition by source, lang order by md5('42' || doc_id::varchar), doc_id) as k from documents) select doc_id, source, lang from s where k <= ceil(m * 20 / n)""")
def stratified_sample(spark, sf):
    return relational.stratified_sample(read(spark, sf, "documents"), "source", "lang", "doc_id", 20).select("doc_id", "source", "lang")


@query("select doc_id from documents order by md5('42' || doc_id::varchar), doc_id limit 100")
def fixed_sample(spark, sf):
    return relational.fixed_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 100)


@query("""with s as (select distinct lang, source as label, text as sentence from documents where doc_id % 3 = 0),
 f as (select lang, text as sentence, doc_id, row_number() over (partition by lang, text order by doc_id) as k from documents)
 select s.lang, s.label, length(s.sentence) as n, f.doc_id from s left join f on s.lang = f.lang and s.sentence = f.sentence and f.k = 1""")
def subset_full_join(spark, sf):
    docs = read(spark, sf, "documents")
    subset = docs.where("doc_id % 3 = 0").select("lang", F.col("source").alias("label"), F.col("text").alias("sentence"))
    full = docs.select("lang", F.col("text").alias("sentence"), "doc_id")
    out = relational.full_rows(subset, full, ["lang", "sentence"], ["doc_id"], ["doc_id"])
    return out.select("lang", "label", F.length("sentence").cast("long").alias("n"), "doc_id")


@query("""with a as (select lang, count(*) as n_before from documents group by lang), b as (select lang, count(*) as n_after from documents where source in ('src1', 'src2') and lang <> 'es' group by lang)
 select coalesce(a.lang, b.lang) as lang, coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after from a full join b on a.lang = b.lang""")
def lang_balance(spark, sf):
    docs = read(spark, sf, "documents")
    return relational.aligned_counts(docs, docs.where("source in ('src1', 'src2') and lang <> 'es'"), "lang")


@query("select floor(log10(n_chars) + 1e-9)::bigint as bin, count(*) as n from documents where n_chars > 0 group by 1")
def plot_histograms(spark, sf):
    return relational.log_histogram(read(spark, sf, "documents"), "n_chars")


# Vectors: queries are every fiftieth row, the corpus the rest.
def vectors_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = read(spark, sf, "embeddings")
    corpus = own.where("vec_id % 50 <> 0").select(
        "vec_id", "embedding", F.col("label").alias("class"),
        F.concat(F.lit("d"), (F.col("label") % 2).cast("string"), F.lit(":i"), (F.col("label") % 4).cast("string")).alias("label"),
    )
    return corpus, own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


DIST = "acos(least(greatest(list_inner_product(q.embedding::double[], c.embedding::double[]), -1.0), 1.0)) / pi()"
PAIRS = f"pairs as (select q.vec_id as qid, c.vec_id, {DIST} as dist, 'd' || (c.label % 2) as dom, 'd' || (c.label % 2) || ':i' || (c.label % 4) as lab from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id % 50 <> 0)"
SIX = "round(dist, 6)"


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0.0, 6) for c in columns or ("dist",)})


def topk_sql(where: str = "true") -> str:
    return f"with {PAIRS}, r as (select *, row_number() over (partition by qid order by dist, vec_id) as rank from pairs where {where}) select qid, vec_id, rank, {SIX} as dist from r where rank <= {K}"


@query("select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings")
def l2_norms(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query("select vec_id, label, " + ", ".join(f"embedding[{k + 1}] as dim_{k}" for k in range(64)) + " from embeddings")
def dims_explode(spark, sf):
    wide = vectors.spread_dims(read(spark, sf, "embeddings"), 64)
    return vectors.spread_dims(vectors.fold_dims(wide.select(*reversed(wide.columns))), 64)


@query(topk_sql())
def knn_topk(spark, sf):
    corpus, q = vectors_of(spark, sf)
    return six(knn.distances(corpus, q, K).select("qid", "vec_id", "rank", "dist"))


@query(topk_sql())
def knn_expressions(spark, sf):
    corpus, q = vectors_of(spark, sf)
    return six(knn.by_expressions(corpus, q, K).select("qid", "vec_id", "rank", "dist"))


@query(topk_sql("dom = 'd1'"))
def knn_scoped(spark, sf):
    corpus, q = vectors_of(spark, sf)
    inside = knn.active(corpus.withColumn("dom", labels.domain(F.col("label"))), ["d1", "unknown"], "dom")
    return six(knn.distances(inside, q, K).select("qid", "vec_id", "rank", "dist"))


@query(f"with {PAIRS}, a as (select qid, min(dist) as anchor from pairs group by qid), r as (select *, row_number() over (partition by qid order by dist, vec_id) as rank from pairs where dom = 'd0') select qid, vec_id, rank, {SIX} as dist, round(anchor, 6) as anchor from r join a using (qid) where rank <= {K}")
def knn_anchor(spark, sf):
    corpus, q = vectors_of(spark, sf)
    found = knn.with_anchor(corpus, q, K, F.col("label").startswith("d0"))
    return six(found.select("qid", "vec_id", "rank", "dist", "anchor"), "dist", "anchor")


@query(topk_sql().replace(f", {SIX} as dist from r", " from r"))
def knn_all_cells(spark, sf):
    """The pruned search with every cell probed, over an index that was written and loaded."""
    corpus, q = vectors_of(spark, sf)
    index = index_store.build(corpus, folder(spark, "index"), index_store.Spec(nlist=8, nprobe=8), cells=True)
    return index.search(q, K).select("qid", "vec_id", "rank")


@query()
def knn_probed(spark, sf):
    corpus, q = vectors_of(spark, sf)
    index = index_store.build(corpus, folder(spark, "index"), index_store.Spec(nlist=8, nprobe=7), cells=True)
    return index.search(q, K)


POOL = f"pool as (select * from (select *, row_number() over (partition by qid order by dist, vec_id) as rank from pairs) where rank <= {K * 20})"
WEIGHTED = """weighted as (select *, least(greatest(exp(-power(dist - anchor, 2) / 0.02), 1e-10), 1.0) * (case when dist > anchor + 0.1 then 0 else 1 end) as w
  from (select *, min(dist) over (partition by qid) as anchor from pool)),
 reach as (select *, greatest(least(10.0, sum(w) over (partition by qid)), 1e-5) as dyn_k from weighted)"""


def pool_of(spark, sf) -> DataFrame:
    corpus, q = vectors_of(spark, sf)
    near = knn.distances(corpus, q, K * 20, carry=["label"])
    return near.withColumn("class", labels.domain(F.col("label")))


@query(f"with {PAIRS}, {POOL}, {WEIGHTED} select qid, vec_id, round(w, 6) as w, round(dyn_k, 6) as dyn_k, min(dist) over (partition by qid) <= 0.05 as exact from reach")
def shell_weights(spark, sf):
    return six(coupling.shell_weights(pool_of(spark, sf)), "w", "dyn_k").select("qid", "vec_id", "w", "dyn_k", "exact")


@query(f"with {PAIRS}, {POOL}, {WEIGHTED} select qid, vec_id, dom as class, round(sum(w) over (partition by qid, dom order by dist, vec_id rows unbounded preceding), 6) as cum from reach")
def cum_class_weights(spark, sf):
    return six(coupling.running_weights(coupling.shell_weights(pool_of(spark, sf))), "cum").select("qid", "vec_id", "class", "cum")


def shares(source: str, cls: str, first: str, second: str, tag: str) -> str:
    """CTEs from (qid, vec_id, dist, w, dyn_k, <cls>) to r11, r12, r21, r22 and p_first by query."""
    return f"""run{tag} as (select qid, dyn_k, sum(case when {cls} = {first} then w else 0 end) over o as c1, sum(case when {cls} = {second} then w else 0 end) over o as c2
  from {source} window o as (partition by qid order by dist, vec_id rows unbounded preceding)),
 raw{tag} as (select qid, coalesce(min(case when 2 * c1 >= dyn_k then c1 end), max(c1)) / min(dyn_k) as a, coalesce(min(case when c1 + c2 >= dyn_k then c1 end), max(c1)) / min(dyn_k) as b,
  coalesce(min(case when c1 + c2 >= dyn_k then c2 end), max(c2)) / min(dyn_k) as c, coalesce(min(case when 2 * c2 >= dyn_k then c2 end), max(c2)) / min(dyn_k) as d from run{tag} group by qid),
 r{tag} as (select qid, a, b + 0.001 * ((b = 0)::int - (c = 0)::int) as b, c + 0.001 * ((c = 0)::int - (b = 0)::int) as c, d from raw{tag}),
 p{tag} as (select qid, (b * b + d * d + b * c) / (a * a + c * c + b * b + d * d + 2 * b * c) as p from r{tag})"""


L1 = f"{PAIRS}, {POOL}, {WEIGHTED}, {shares('reach', 'dom', chr(39) + 'd0' + chr(39), chr(39) + 'd1' + chr(39), '1')}"


@query(f"with {L1} select qid, 'd0' as ci, 'd0' as cj, round(a, 6) as r from r1 union all select qid, 'd0', 'd1', round(b, 6) from r1 union all select qid, 'd1', 'd0', round(c, 6) from r1 union all select qid, 'd1', 'd1', round(d, 6) from r1")
def pairwise_r(spark, sf):
    return six(coupling.pairwise_rows(coupling.shell_weights(pool_of(spark, sf)), classes=["d0", "d1"]), "r")


@query(f"with {L1} select qid, round(p, 6) as p_first from p1")
def l1_closed_form(spark, sf):
    rows = coupling.pairwise_rows(coupling.shell_weights(pool_of(spark, sf)), classes=["d0", "d1"])
    return six(coupling.two_classes(rows, "d0", "d1"), "p_first")


def model_of(spark, sf, **options) -> tuple[classify.Model, DataFrame]:
    corpus, q = vectors_of(spark, sf)
    return classify.Model(corpus, **options), q


@query(f"with {L1}, sides as (select qid, 'd0' as label, p from p1 union all select qid, 'd1', 1 - p from p1) select qid, 1 as level, row_number() over (partition by qid order by p desc, label) as rank, label, round(p, 6) as prob from sides")
def l1_proba(spark, sf):
    model, q = model_of(spark, sf)
    return six(classify.predict_proba(model, q, level=1).drop("degenerate"), "prob")


TOP1 = f"""{L1}, top1 as (select qid, case when p >= 0.5 then 'd0' else 'd1' end as dom from p1),
 pool2 as (select * from (select x.*, row_number() over (partition by x.qid order by x.dist, x.vec_id) as k2 from pairs x join top1 t on x.qid = t.qid and x.dom = t.dom) where k2 <= {K * 20}),
 w2 as (select y.*, least(greatest(exp(-power(y.dist - g.anchor, 2) / 0.02), 1e-10), 1.0) * (case when y.dist > g.anchor + 0.1 then 0 else 1 end) as w from pool2 y join (select qid, min(dist) as anchor from pairs group by qid) g using (qid)),
 reach2 as (select *, greatest(least(10.0, sum(w) over (partition by qid)), 1e-5) as dyn_k from w2),
 {shares('reach2', 'lab', "dom || ':i' || right(dom, 1)", "dom || ':i' || (right(dom, 1)::int + 2)", '2')},
 best as (select qid, case when p >= 0.5 then dom || ':i' || right(dom, 1) else dom || ':i' || (right(dom, 1)::int + 2) end as label, greatest(p, 1 - p) as prob from p2 join top1 using (qid))"""


def truth_of(spark, sf) -> DataFrame:
    label = F.concat(F.lit("d"), (F.col("label") % 2).cast("string"), F.lit(":i"), (F.col("label") % 4).cast("string"))
    return read(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), label.alias("label"))


@query(f"with {TOP1} select qid, label, round(prob, 6) as prob from best")
def predict_top1(spark, sf):
    model, q = model_of(spark, sf, n=1, renormalize=False)
    return six(classify.predict(model, q), "prob")


def coupled(source: str, cls: str, names: list[str], tag: str) -> str:
    """CTEs from (qid, vec_id, dist, w, dyn_k, <cls>) to s<tag>: qid, empty and x0, x1, ..., the coupled
    probability of each class, by elimination of the linear system written out."""
    n = len(names)
    order = "window o as (partition by qid order by dist, vec_id rows unbounded preceding)"
    running = ", ".join(f"sum(case when {cls} = '{c}' then w else 0 end) over o as c{i}" for i, c in enumerate(names))
    shared = ", ".join(f"coalesce(min(case when c{i} + c{j} >= dyn_k then c{i} end), max(c{i})) / min(dyn_k) as a{i}_{j}" for i in range(n) for j in range(n))
    smooth = ", ".join(f"a{i}_{j} + 0.001 * ((a{i}_{j} = 0)::int - (a{j}_{i} = 0)::int) as r{i}_{j}" for i in range(n) for j in range(n))
    cell = lambda i, j: (
        "0.0" if i == j == n or (j == n + 1 and i < n) else "1.0" if n in (i, j) or j == n + 1 else " + ".join(f"r{k}_{j} * r{k}_{j}" for k in range(n)) if i == j else f"-r{i}_{j} * r{j}_{i}"
    )
    steps = [f"e{tag}_0 as (select qid, empty, {', '.join(f'{cell(i, j)} as m{i}_{j}' for i in range(n + 1) for j in range(n + 2))} from r{tag})"]
    for k in range(n + 1):
        kept = ", ".join(
            f"m{k}_{j} / m{k}_{k} as m{k}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} as m{i}_{j}" for i in range(n + 1) for j in range(k + 1, n + 2)
        )
        steps.append(f"e{tag}_{k + 1} as materialized (select qid, empty, {kept} from e{tag}_{k})")
    total = " + ".join(f"m{i}_{n + 1}" for i in range(n))
    found = ", ".join(f"case when empty then 1.0 / {n} else m{i}_{n + 1} / ({total}) end as x{i}" for i in range(n))
    return f"""run{tag} as (select qid, w, dyn_k, {running} from {source} {order}),
 raw{tag} as materialized (select qid, sum(w) = 0 as empty, {shared} from run{tag} group by qid),
 r{tag} as materialized (select qid, empty, {smooth} from raw{tag}), {", ".join(steps)},
 s{tag} as (select qid, empty, {found} from e{tag}_{n + 1})"""


NAMES = [f"d{k % 2}:c{k}" for k in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]
NEAR = f"""(select qid, vec_id, dist, cls, dom, least(greatest(exp(-power(dist - anchor, 2) / 0.02), 1e-10), 1.0) * (case when dist > anchor + 0.1 then 0 else 1 end) as w
  from (select *, row_number() over (partition by qid order by dist, vec_id) as k from (select p.*, a.anchor from cpairs p join (select qid, min(dist) as anchor from cpairs group by qid) a using (qid)))"""
PROBA = f"""cpairs as (select q.vec_id as qid, c.vec_id, {DIST} as dist, 'd' || (c.label % 2) as dom, 'd' || (c.label % 2) || ':c' || c.label as cls from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id % 50 <> 0),
 near1 as {NEAR} where k <= {K * 20}), near2 as {NEAR} where k <= {K * 100}),
 got1 as (select *, greatest(least(10.0, sum(w) over (partition by qid)), 1e-5) as dyn_k from near1), got2 as (select *, greatest(least(10.0, sum(w) over (partition by qid)), 1e-5) as dyn_k from near2),
 {coupled("got1", "dom", ["d0", "d1"], "A")}, {coupled("got2", "cls", NAMES, "B")},
 joint as (select b.qid, b.empty, unnest([{", ".join(f"{{'label': '{c}', 'p': {'a.x0' if c.startswith('d0') else 'a.x1'} * b.x{i}}}" for i, c in enumerate(NAMES))}]) as u from sB b join sA a using (qid)),
 ranked as (select qid, empty, u.label as label, u.p as p, row_number() over (partition by qid order by round(u.p, 12) desc, u.label) as rank from joint)"""


@query(
    f"""with {PROBA} select qid, 2 as level, rank, label, round(p / sum(p) over (partition by qid), 6) as prob, empty as degenerate from ranked where rank <= 5
 union all select qid, 1, row_number() over (partition by qid order by round(p, 12) desc, label), label, round(p, 6), empty from (select qid, empty, unnest(['d0', 'd1']) as label, unnest([x0, x1]) as p from sA)"""
)
def predict_proba(spark, sf):
    corpus, q = vectors_of(spark, sf)
    own = corpus.withColumn("label", F.concat(labels.domain(F.col("label")), F.lit(":c"), F.col("class").cast("string")))
    return six(classify.predict_proba(classify.Model(own), q, every_level=True), "prob")


FILTERED = f"""{PAIRS}, dpool as (select * from (select *, row_number() over (partition by qid order by dist, vec_id) as k2 from pairs where dom = 'd0') where k2 <= {K * 20}),
 w2 as (select y.*, least(greatest(exp(-power(y.dist - g.anchor, 2) / 0.02), 1e-10), 1.0) * (case when y.dist > g.anchor + 0.1 then 0 else 1 end) as w from dpool y join (select qid, min(dist) as anchor from pairs group by qid) g using (qid)),
 reach2 as (select *, greatest(least(10.0, sum(w) over (partition by qid)), 1e-5) as dyn_k from w2), {coupled("reach2", "lab", ["d0:i0", "d0:i2"], "F")}"""


@query(f"with {FILTERED} select qid, 2 as level, row_number() over (partition by qid order by round(p, 12) desc, label) as rank, label, round(p, 6) as prob, empty as degenerate from (select qid, empty, unnest(['d0:i0', 'd0:i2']) as label, unnest([x0, x1]) as p from sF)")
def predict_filtered(spark, sf):
    model, q = model_of(spark, sf)
    return six(classify.predict_proba(model, q, domains=["d0"]), "prob")


@query(f"with {TOP1} select qid, label, round(prob, 6) as prob from best")
def predict_by_cells(spark, sf):
    """Prediction through an index whose cells are all probed."""
    corpus, q = vectors_of(spark, sf)
    index = index_store.build(corpus, folder(spark, "index"), index_store.Spec(n=1, nlist=8, nprobe=8, renormalize=False), cells=True)
    return six(classify.predict(index.model(), q), "prob")


def registered(spark: SparkSession, *intents: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in intents])).alias("intent"))


@query(f"with {TOP1}, tiers(tier, least) as (values ('high', 0.7), ('medium', 0.5), ('low', 0.15)) select qid, tier, split_part(label, ':', 1) as skill_id, label as match_type, round(prob, 6) as prob from best, tiers where label in ('d0:i0', 'd1:i1', 'd1:i3') and prob >= least")
def match_tiers(spark, sf):
    model, q = model_of(spark, sf, n=1, renormalize=False)
    found = gate.candidates(classify.predict(model, q), registered(spark, "d0:i0", "d1:i1", "d1:i3"))
    return six(gate.tiers(found), "prob")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    names = [F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string"), F.lit(":i"), (F.col("doc_id") % 4).cast("string")), F.when(F.col("doc_id") % 2 == 0, "ocp:play").otherwise(F.lit("ocp:play.intent")), F.lit("stop:stop"), F.lit("")]
    rows = F.array(*[F.struct(n.alias("label"), (((F.col("doc_id") * 7 + k * 13) % 100) / 100.0).alias("prob")) for k, n in enumerate(names)])
    return read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.inline(rows))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    stages = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("x-ocp-pipeline-plugin-high"), F.lit("y"))).when(F.col("doc_id") % 5 == 1, F.array(F.lit("y"))).when(F.col("doc_id") % 5 == 2, F.array().cast("array<string>"))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), stages.alias("pipeline"))


PREDICTIONS = """pred as (select doc_id as qid, 'd' || (doc_id % 2) || ':i' || (doc_id % 4) as label, (doc_id * 7 % 100) / 100.0 as prob from documents
 union all select doc_id, case doc_id % 2 when 0 then 'ocp:play' else 'ocp:play.intent' end, ((doc_id * 7 + 13) % 100) / 100.0 from documents union all select doc_id, 'stop:stop', ((doc_id * 7 + 26) % 100) / 100.0 from documents union all select doc_id, '', ((doc_id * 7 + 39) % 100) / 100.0 from documents),
 sess as (select doc_id as qid, case doc_id % 5 when 0 then ['x-ocp-pipeline-plugin-high', 'y'] when 1 then ['y'] when 2 then []::varchar[] end as pipeline from documents),
 special as (select qid, s.label from sess, (values ('ocp:play', 'ocp-pipeline-plugin'), ('common_query:common_query', 'common-query-pipeline-plugin'), ('stop:stop', 'stop-pipeline-plugin')) s(label, needle)
   where pipeline is null or len(pipeline) = 0 or len(list_filter(pipeline, lambda p: contains(p, needle))) > 0)"""


@query(f"""with {PREDICTIONS}, ok as (select * from pred p where label <> '' and (label in ('d0:i0', 'd1:i3') or exists (select 1 from special s where s.qid = p.qid and s.label = replace(p.label, '.intent', '')))),
 n as (select *, row_number() over (partition by qid order by prob desc, label) as rank, case when sum(prob) over (partition by qid) > 0 then prob / sum(prob) over (partition by qid) else prob end as share from ok)
 select qid, rank, case replace(label, '.intent', '') when 'ocp:play' then 'common_play' when 'stop:stop' then 'stop' else split_part(label, ':', 1) end as skill_id,
 case replace(label, '.intent', '') when 'ocp:play' then 'common_play.play_search' when 'stop:stop' then 'stop' else label end as match_type, round(share, 6) as prob from n""")
def match_candidates(spark, sf):
    options = gate.Gate(ignore=("d0:i2",), renormalize=True)
    found = gate.candidates(predictions(spark, sf), registered(spark, "d0:i0", "d1:i3", "d0:i2"), sessions=sessions(spark, sf), gate=options)
    return six(found, "prob")


@query(f"with {PREDICTIONS} select qid, label from special")
def session_gate(spark, sf):
    return sessions(spark, sf).select("qid", F.explode(gate.allowed_special(F.col("pipeline"))).alias("label"))


@query("""select e.label, count(*) as n, round((select avg(1 - list_inner_product(a.embedding::double[], b.embedding::double[])) from embeddings a, embeddings b where a.label = e.label and b.label = e.label and a.vec_id <> b.vec_id), 6) as diversity from embeddings e group by e.label""")
def pairwise_cosine_diversity(spark, sf):
    return six(analysis.cosine_diversity(read(spark, sf, "embeddings")), "diversity")


@query(f"select q.label, (select count(*) from embeddings e where e.label = q.label) as n, round(avg({DIST}), 6) as spread from embeddings q join embeddings c on q.label = c.label and q.vec_id < c.vec_id group by q.label")
def angular_spread(spark, sf):
    return six(analysis.angular_spread(read(spark, sf, "embeddings")), "spread")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "embeddings").select(F.col("vec_id").alias("seq"), F.col("label").cast("string").alias("label"), "embedding")
    words = F.concat_ws(" ", F.lit("w"), (F.col("seq") % 17).cast("string"), (F.col("seq") % 5).cast("string"))
    lang = F.when(F.col("seq") % 3 == 0, "en").otherwise("de")
    return own.withColumn("sentence", words).withColumn("lang", lang)


@query()
def diverse_subset(spark, sf):
    return analysis.diverse_subset(sentences(spark, sf), cap=10, caps={"3": 20}).select("seq", "label", "sentence")


SENTENCES = "sents as (select vec_id as seq, label::varchar as label, 'w ' || (vec_id % 17) || ' ' || (vec_id % 5) as sentence, case when vec_id % 3 = 0 then 'en' else 'de' end as lang, embedding from embeddings)"
BAGS = "list_sort(list_distinct(string_split(sentence, ' ')))"


@query(f"with {SENTENCES} select label, least(count(distinct {BAGS}), case label when '3' then 20 else 10 end) as n from sents group by label")
def diverse_counts(spark, sf):
    return relational.counts(diverse_subset(spark, sf), "label")


@query()
def subset_stats(spark, sf):
    own = sentences(spark, sf)
    return analysis.subset_stats(own, analysis.diverse_subset(own, cap=10))


@query(f"""with {SENTENCES} select s.label, count(*) as n_before, count(distinct {BAGS}) as n_deduped, least(count(distinct {BAGS}), 10) as n_after,
 round((select avg(1 - list_inner_product(a.embedding::double[], b.embedding::double[])) from sents a, sents b where a.label = s.label and b.label = s.label and a.seq <> b.seq), 4) as div_before,
 round(100 * least(count(distinct {BAGS}), 10) / count(*), 1) as kept_pct from sents s group by s.label""")
def subset_counts(spark, sf):
    return subset_stats(spark, sf).select("label", "n_before", "n_deduped", "n_after", "div_before", "kept_pct")


def made_stats(spark, sf) -> DataFrame:
    """A table shaped as the subset's stats: sources of documents, with lengths for diversities."""
    own = read(spark, sf, "documents").groupBy(F.concat_ws("-", "source", "lang").alias("label"))
    return own.agg(
        F.count(F.lit(1)).alias("n_before"), F.countDistinct("text").alias("n_after"), (F.min("n_chars") / 1000).alias("div_before"), (F.max("n_chars") / 1000).alias("div_after"),
    )


STATS = "stats as (select source || '-' || lang as label, count(*) as n_before, count(distinct text) as n_after, min(n_chars) / 1000 as div_before, max(n_chars) / 1000 as div_after from documents group by 1)"


@query(f"with {STATS} select sum(n_before)::bigint as n_before, sum(n_after)::bigint as n_after, round(100 * sum(n_after) / sum(n_before), 1) as kept_pct, count(*) as n_labels, round(avg(div_before), 6) as div_before, round(avg(div_after), 6) as div_after from stats")
def subset_summary(spark, sf):
    return six(jobs.summary(made_stats(spark, sf)), "div_before", "div_after")


@query(f"with {STATS} select label, n_before, n_after from stats where n_before > n_after order by n_before desc, label limit 10")
def trimmed_labels(spark, sf):
    return jobs.trimmed(made_stats(spark, sf)).select("label", "n_before", "n_after")


@query()
def topology_report(spark, sf):
    return analysis.topology(read(spark, sf, "embeddings"))


@query(f"""select q.label::varchar as "Intent", (select count(*) from embeddings e where e.label = q.label) as "Total_Samples", round(avg({DIST}), 4) as "Spread_Score" from embeddings q join embeddings c on q.label = c.label and q.vec_id < c.vec_id group by q.label""")
def topology_spread(spark, sf):
    return topology_report(spark, sf).select("Intent", "Total_Samples", "Spread_Score")


@query()
def medoids(spark, sf):
    return analysis.medoids(read(spark, sf, "embeddings"), 12)


def uneven(spark, sf) -> DataFrame:
    """Labels of very different sizes, so that every branch of balancing runs: of 100 rows in order,
    60 are of one label, 25, 12 and 3 of others; the smallest has entities."""
    own = sentences(spark, sf)
    place = F.col("seq") % 100
    label = F.when(place < 60, "huge").when(place < 85, "large").when(place < 97, "kept").otherwise("short")
    slots = F.when(label == "short", F.concat(F.lit("play {track_name} "), F.col("seq").cast("string")))
    original = F.coalesce(slots, F.concat(F.lit("s "), F.col("seq").cast("string")))
    return own.withColumns({"label": label, "entity": F.when(slots.isNotNull(), "track_name"), "original_sentence": original, "sentence": original})


def shares_of(spark, sf) -> jobs.Balance:
    n = read(spark, sf, "embeddings").count()
    return jobs.Balance(huge=n * 40 // 100, large=n * 15 // 100, small=n * 5 // 100, variants=3)


@query()
def balance_job(spark, sf):
    return jobs.balance(uneven(spark, sf), shares_of(spark, sf), id="seq").select("seq", "label", "sentence")


@query("""with t as (select count(*) as total from embeddings), l as (select case when vec_id % 100 < 60 then 'huge' when vec_id % 100 < 85 then 'large' when vec_id % 100 < 97 then 'kept' else 'short' end as label,
   case when vec_id % 3 = 0 then 'en' else 'de' end as lang from embeddings),
 g as (select label, lang, count(*) as m from l group by label, lang), c as (select g.*, total, sum(m) over (partition by label) as s from g, t)
 select label, case label when 'large' then sum(ceil(m * (total * 15 // 100) / s))::bigint when 'kept' then sum(m)::bigint else 4 * sum(m)::bigint end as n from c where label <> 'huge' group by label""")
def balance_counts(spark, sf):
    """Rows of the labels that are sampled, kept or refilled; those of medoids follow k-means."""
    return relational.counts(balance_job(spark, sf).where("label <> 'huge'"), "label")


@query(rf"""with {RAW}, c as (select * from raw where label is not null and trim(sentence) <> '' and regexp_matches(sentence, '\{{[^}}]+\}}'))
 select regexp_replace(trim(label), '(\.intent)+$', '') || '.intent' as label, 10 * count(*) as n from c group by 1""")
def variant_counts(spark, sf):
    return relational.counts(faker_variants(spark, sf), "label")


# Files: written to the shared folder and read back.
@query(rf"with {RAW} select p_partkey::varchar as p_partkey, label, lang, sentence from raw where trim(sentence) <> ''")
def csv_round_trip(spark, sf):
    path = folder(spark, "raw")
    tables.write_csv(raw_intents(spark, sf).where("trim(sentence) <> ''"), path)
    return tables.read_dataset(spark, path)[0]


@query("select 'd:' || item_id as label, text as utterance from benchmark")
def json_lines(spark, sf):
    path = folder(spark, "golden")
    own = read(spark, sf, "benchmark").select(F.concat(F.lit("d:"), F.col("item_id").cast("string")).alias("label"), F.col("text").alias("utterance"))
    own.write.mode("overwrite").json(path)
    return tables.read_golden(spark, path)


@query("select vec_id, label, embedding from embeddings")
def dims_round_trip(spark, sf):
    path = tables.write_parquet(read(spark, sf, "embeddings"), f"{folder(spark, 'vectors')}/v.csv", dims=64)
    return tables.read_dataset(spark, path)[0].select("vec_id", "label", "embedding")


@query(f"with {TOP1} select qid, label as match_type, round(prob, 6) as confidence, split_part(label, ':', 1) as skill_id, 'say ' || qid as utterance from best where label in ('d0:i0', 'd1:i1') and prob >= 0.5")
def match_emitted(spark, sf):
    model, q = model_of(spark, sf, n=1, renormalize=False)
    found = gate.candidates(classify.predict(model, q), registered(spark, "d0:i0", "d1:i1"))
    said = q.select("qid", F.concat(F.lit("say "), F.col("qid").cast("string")).alias("utterance"))
    out = gate.match(found, "medium", utterances=said)
    return six(out.select("qid", "match_type", F.col("match_data.confidence").alias("confidence"), "skill_id", "utterance"), "confidence")


@query(f"""with {TOP1} select b.qid, b.label, 'd' || (e.label % 2) || ':i' || (e.label % 4) as truth from best b join embeddings e on b.qid = e.vec_id where b.label <> 'd' || (e.label % 2) || ':i' || (e.label % 4)""")
def report_misses(spark, sf):
    model, q = model_of(spark, sf, n=1, renormalize=False)
    return classify.misses(classify.predict(model, q), truth_of(spark, sf))


@query()
def encode_job(spark, sf):
    own = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("sentence"))
    return jobs.encode_dataset(own, EncoderSpec(dim=32))


@query(f"with {TOP1} select count(*) as n, count(*) filter (where b.label = 'd' || (e.label % 2) || ':i' || (e.label % 4))::bigint as n_correct, round(avg((b.label = 'd' || (e.label % 2) || ':i' || (e.label % 4))::int), 6) as accuracy from best b join embeddings e on b.qid = e.vec_id")
def accuracy_report(spark, sf):
    model, q = model_of(spark, sf, n=1, renormalize=False)
    return six(classify.accuracy(classify.predict(model, q), truth_of(spark, sf)), "accuracy")


SNAPSHOT = """c as (select 'u' || user_id as skill, 'k' || json_extract_string(props, '$.k') as intent, event_type, ts, event_id from events where event_type in ('signup', 'error')),
 l as (select skill, intent, arg_max(event_type, (ts, event_id)) as last from c group by skill, intent)"""


def change_events(spark, sf) -> DataFrame:
    return read(spark, sf, "events").where("event_type in ('signup', 'error')").select(
        "event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("skill"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("intent"),
        F.when(F.col("event_type") == "signup", "register").otherwise("detach").alias("kind"),
    )


@query(f"with {SNAPSHOT} select skill, intent from l where last = 'signup'")
def registry_snapshot(spark, sf):
    return gate.snapshot(change_events(spark, sf), key=["skill", "intent"], order="event_id")


@query(f"with {SNAPSHOT} select distinct intent from l where last = 'signup'")
def registry_stream_kept(spark, sf):
    """The same through the stream: files of changes, keyed state, and the snapshot that is kept."""
    root = folder(spark, "changes")
    own = change_events(spark, sf).withColumnRenamed("skill", "source").select("event_id", "ts", "source", "kind", "intent")
    own.repartitionByRange(3, "ts").write.mode("overwrite").parquet(f"{root}/in")
    registry_stream.keep_snapshot(registry_stream.changes(spark, f"{root}/in", files=1), f"{root}/kept", f"{root}/check", seconds=None, delay="1000 days").awaitTermination()
    return registry_stream.registered(spark, f"{root}/kept")


@query("""select distinct 'd' || (label % 2) as domain from embeddings union select 'ocp' union select 'common_query' union select 'stop'""")
def active_domains(spark, sf):
    corpus, _ = vectors_of(spark, sf)
    return gate.active_domains(corpus.select(F.col("label").alias("intent")))
