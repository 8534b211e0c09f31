import collections
import csv
import io
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import pipeline, sinks
from corpusmill.functions.store_types import normalized_store_type
from corpusmill.operators import catalog, near_duplicates, retrieve, term_index, vector_index
from corpusmill.session import scratch_path, shared_dir
from corpusmill.sources import fetch, files, landed
from corpusmill.sources.fetch import FetchQuery
from corpusmill.streaming import streams


def test_select_rows(spark):
    rows = spark.createDataFrame([(1, "Widget", 9.5), (2, "Gizmo", 2.5), (3, "Other", 1.0)], "id int, name string, price double")
    assert [r["id"] for r in fetch.select_rows(rows, FetchQuery("p", filters={"name": "Gizmo", "price": 2.5})).collect()] == [2]
    page = FetchQuery("p", columns=["id"], limit=1, offset=1, order_by=["price"])
    assert [tuple(r) for r in fetch.select_rows(rows, page).collect()] == [(2,)]
    with pytest.raises(ValueError):
        fetch.select_rows(rows, FetchQuery("p", offset=1))


@pytest.mark.parametrize(
    "store, url",
    [
        ("postgresql", "jdbc:postgresql://h:5432/d"), ("mysql", "jdbc:mysql://h:3306/d"), ("redshift", "jdbc:redshift://h:5439/d"),
        ("mssql", "jdbc:sqlserver://h:1433;databaseName=d"), ("oracle", "jdbc:oracle:thin:@//h:1521/d"), ("sqlite", "jdbc:sqlite:d"),
    ],
)
def test_jdbc_urls(store, url):
    assert fetch.jdbc_options(store, FetchQuery("t"), host="h", database="d")["url"] == url


def test_jdbc_options():
    options = fetch.jdbc_options("postgresql", FetchQuery("t", raw_query="SELECT 1"), user="u", password="p")
    assert options["query"] == "SELECT 1" and "dbtable" not in options and options["user"] == "u"
    split = fetch.jdbc_options("mysql", FetchQuery("t"), split_by=("id", 0, 100, 8))
    assert split["dbtable"] == "t" and split["numPartitions"] == "8" and split["partitionColumn"] == "id"


def test_row_documents(spark):
    rows = spark.createDataFrame([(1, None, True)], "id int, name string, ok boolean")
    doc = fetch.row_documents(rows, store="sqlite", table="users").first()
    assert doc["content"] == "id=1, name=None, ok=True" and doc["source_ref"] == "sqlite://users"
    assert json.loads(doc["row"]) == {"id": 1, "name": None, "ok": True}


def test_incremental(spark):
    rows = spark.range(10)
    assert fetch.fetch_since(rows, key="id", checkpoint=6).count() == 3
    assert tuple(fetch.next_checkpoint(rows, key="id", checkpoint=6).first()) == (9, 3)
    assert tuple(fetch.next_checkpoint(rows, key="id", checkpoint=50).first()) == (50, 0)


def test_match_is_any_word(spark):
    rows = spark.createDataFrame([("The quick fox",), ("slow dog",)], "t string")
    assert [r["t"] for r in fetch.match_text(rows, {"t": "Quick, cat"}).collect()] == ["The quick fox"]


@pytest.mark.parametrize(
    "store, kind, name",
    [
        ("postgresql", "TIMESTAMP WITHOUT TIME ZONE", "datetime"), ("postgresql", "INT", "string"), ("postgresql", "NUMERIC(10, 2)", "float"),
        ("mssql", "INT", "integer"), ("mysql", "tinyint(1)", "integer"), ("oracle", "NUMBER(38)", "float"), ("bigquery", "INT64", "integer"),
        ("cassandra", "list<text>", "json"), ("dynamodb", "N", "float"), ("elasticsearch", "half_float", "float"), ("redis", "zset", "json"),
        ("snowflake", "VARIANT", "json"), ("sqlite", "GEOMETRY", "string"), ("redshift", "SUPER", "json"),
    ],
)
def test_store_types(spark, store, kind, name):
    row = spark.createDataFrame([(kind,)], "t string").select(normalized_store_type(store, F.col("t")).alias("n")).first()
    assert row["n"] == name


def test_files(spark, tmp_path):
    (tmp_path / "file1.csv").write_text('name,age\nann,3\n"b, c",\n')
    (tmp_path / "file2.csv").write_text("name,age\ndan,4\n")
    (tmp_path / "records.json").write_text('[{"a": 1, "b": null}, {"a": 2}]')
    (tmp_path / "single.json").write_text('{"a": 3}')
    (tmp_path / "broken.json").write_text("{oops")
    (tmp_path / "note.txt").write_text("line one\nline two")
    docs = files.object_documents(spark, str(tmp_path)).collect()
    found = {(r["metadata"]["format"], r["content"]) for r in docs}
    assert found == {
        ("csv", '{"name":"ann","age":"3"}'), ("csv", '{"name":"b, c","age":""}'), ("csv", '{"name":"dan","age":"4"}'),
        ("json", '{"a":1,"b":null}'), ("json", '{"a":2}'), ("json", '{"a":3}'), ("text", "{oops"), ("text", "line one\nline two"),
    }
    assert files.csv_documents(spark, str(tmp_path), limit=2).count() == 2  # broken.json and file1.csv
    summary = files.csv_file_summary(spark, str(tmp_path)).collect()
    assert sorted(r["row_count"] for r in summary) == [1, 2] and {r["headers"] for r in summary} == {"name,age"}
    kinds = catalog.file_collections(files.list_files(spark, str(tmp_path)))
    assert {r["collection"]: r["row_count"] for r in kinds.collect()} == {"csv": 2, "json": 3, "txt": 1}


def test_csv_tasks_follow_the_size_of_files(spark, tmp_path, monkeypatch):
    """Splits and records are dealt to as many tasks as the bytes ask for, and no join brings a file's records to one task."""
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f'{i},"line {i}\nnext"\n' for i in range(200)))
    monkeypatch.setattr(files, "PART_BYTES", 100)
    rows, _ = files.csv_rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert ", 38), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin [_path" in plan
    assert sorted(int(r["values"][0]) for r in rows.collect()) == list(range(200))


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,age\n"x ""y"" z",3\n\nbob\n')
    (tmp_path / "b.csv").write_text("city,zip\n,7,9\n")
    (tmp_path / "c.csv").write_text("only,header\n")
    docs = {r["content"] for r in files.csv_documents(spark, str(tmp_path)).collect()}
    assert docs == {'{"name":"x \\"y\\" z","age":"3"}', '{"name":"bob","age":""}', '{"city":"","zip":"7"}'}
    summary = {r["source_ref"][-5:]: (r["headers"], r["row_count"]) for r in files.csv_file_summary(spark, str(tmp_path)).collect()}
    assert summary == {"a.csv": ("name,age", 2), "b.csv": ("city,zip", 1), "c.csv": ("only,header", 0)}


csv.field_size_limit(1 << 30)
CSV_FILES = {
    "w1.csv": 'name,note\nann,plain\nbob,"two\nlines, one field"\ncy,"a ""quoted"" word"\n',
    "crlf.csv": 'a,b\r\n"x\r\ny",1\r\n,"\r\n"\r\n"",""\r\n',
    "stray.csv": 'a,b\nit"s,5"\n"closed"tail,"x"\n"a""",""""\n  "no",quote\n',
    "blank.csv": 'a,b\n\n"one\n\n\ntwo",2\n\n   ,3\n',
    "never.csv": 'a,b\n1,2\n"open, to the\nend,3\n4,5\n',
    "header.csv": '"first\nname",b\n1,2\n"3\n",4',
    "commas.csv": 'a,b,c\n,,\n"",,"a,b"\n",",",\n","\n"\n',
    "long.csv": 'a,b\n1,"' + 'x""y\n' * 4000 + '"\n2,"' + "z" * 1_000_000 + '"\n3,plain\n',
    "mac.csv": 'a,b\r1,"x\ry"\r2,3\r',
    "bom.csv": '\ufeffa,b\n1,"\n\ufeff"\n',
}


def csv_by_python(text):
    """What Python's csv makes of a file: header and rows, filled up and cut to the header."""
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline="")) if r]
    return tuple(rows[0]), sorted(tuple((r + [""] * len(rows[0]))[: len(rows[0])]) for r in rows[1:])


@pytest.mark.parametrize("split", [None, 64, 7])
def test_csv_as_python_reads_it(spark, tmp_path, split):
    """Quoted line breaks, stray quotes and long fields, whole and over many splits."""
    rng = random.Random(split)
    made = {f"r{k}.csv": "h,i\n" + "".join(rng.choice('",\n"ab\n') for _ in range(300)) + "\n" for k in range(6)}
    named = {n: t for n, t in {**CSV_FILES, **made}.items() if split is None or len(t) < 2000}
    for name, text in named.items():
        (tmp_path / name).write_bytes(text.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        if split:
            for key, value in zip(keys, (split, 1, 1)):
                spark.conf.set(key, str(value))
        rows, headers = files.csv_rows(spark, str(tmp_path))
        found = {r["_path"].rsplit("/", 1)[1]: (tuple(r["header"]), []) for r in headers.collect()}
        for r in rows.collect():
            found[r["_path"].rsplit("/", 1)[1]][1].append(tuple(r["values"]))
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert {n: (h, sorted(r)) for n, (h, r) in found.items()} == {n: csv_by_python(t) for n, t in named.items()}


@pytest.mark.parametrize("glob, key, ok", [("user:*", "user:1", True), ("user:?", "user:12", False), ("[us]*", "session:a", True), ("a.c", "abc", False), ("[^u]*", "user", False)])
def test_globs(spark, glob, key, ok):
    assert spark.range(1).select(F.rlike(F.lit(key), F.lit(landed.glob_pattern(glob))).alias("m")).first()["m"] is ok


def test_key_values(spark):
    rows = [("user:1", "hash", '{"n":"a"}', 0), ("user:2", "string", 'b"', 1), ("session:abc", "string", "x", 2)]
    pairs = spark.createDataFrame(rows, "key string, type string, value string, ordinal int")
    found = [json.loads(r["content"]) for r in landed.key_value_documents(pairs, pattern="user:*").collect()]
    assert sorted(found, key=lambda d: d["key"]) == [{"key": "user:1", "value": {"n": "a"}}, {"key": "user:2", "value": 'b"'}]
    groups = catalog.key_value_collections(pairs, order_by="ordinal")
    assert {r["collection"]: r["data_type"] for r in groups.collect()} == {"user": "json", "session": "string"}


def test_index_mappings(spark):
    mapping = {"books": {"mappings": {"properties": {"title": {"type": "text"}, "pages": {"type": "long"}, "meta": {}}}}}
    rows = spark.createDataFrame([(json.dumps(mapping),)], "mapping string")
    assert {r["field"]: r["data_type"] for r in catalog.index_fields(rows).collect()} == {"title": "string", "pages": "integer", "meta": "json"}


def test_messages(spark):
    rows = spark.createDataFrame([("t", 0, 1, bytearray(b"hi")), ("t", 0, 2, None)], "topic string, partition int, offset long, value binary")
    docs = landed.message_documents(rows).collect()
    assert [(d["content"], d["source_ref"], d["metadata"]["offset"]) for d in docs] == [("hi", "kafka://t", "1")]


def test_experiment_log(spark):
    path = scratch_path(spark, "log")
    rows = spark.createDataFrame([("exp-1", 1.5, 'a\t"b"\nc'), ("exp-2", None, None)], "experiment_id string, val_bpb double, reasoning string")
    sinks.write_experiment_log(rows, path)
    sinks.write_experiment_log(rows.limit(1), path)
    back = [(r["experiment_id"], r["val_bpb"], r["reasoning"]) for r in sinks.read_experiment_log(spark, path).collect()]
    assert sorted(back, key=str) == [("exp-1", 1.5, 'a\t"b"\nc')] * 2 + [("exp-2", None, None)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(3, 160))
        texts.append(base)
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy + rng.choices(vocabulary, k=rng.randint(0, 2)))
    texts += [[], [], ["one"], ["one"], ["one", "two"]]
    rng.shuffle(texts)
    for threshold in (0.95, 0.8):
        sets = [{tuple(t[i : i + 3]) for i in range(max(len(t) - 2, 1))} for t in texts]
        kept = []
        for i, s in enumerate(sets):
            if not any(len(s & sets[k]) / len(s | sets[k]) >= threshold for k in kept):
                kept.append(i)
        rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, content string").repartition(4)
        found = near_duplicates.first_of_near_duplicates(rows, threshold=threshold)
        assert sorted(r["doc_id"] for r in found.collect()) == kept


def test_lookalikes_settle_in_few_rounds(spark, monkeypatch):
    """200 documents of similarity 0.94 that share all but their own words, and a chain of similar ones among them."""
    cuts = []
    cut = near_duplicates.cut_lineage
    monkeypatch.setattr(near_duplicates, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[: 20 * 17] + [f"own{k}x{j}" for j in range(8)] + base[:8]) for k in range(200)]
    chain = [f"c{i}" for i in range(600)]
    texts += [" ".join([*chain[:400], f"end{k}", *[f"s{j}" for j in range(k, k + 12)]]) for k in range(40)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if not any(len(s & sets[k]) / len(s | sets[k]) >= 0.95 for k in kept):
            kept.append(i)
    assert 200 < len(kept) < 225
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").repartition(4)
    found = near_duplicates.first_of_near_duplicates(rows, threshold=0.95)
    assert sorted(r["doc_id"] for r in found.collect()) == kept
    assert len(cuts) < 40


def test_settling_of_dependencies(spark):
    rng = random.Random(12)
    graphs = [[(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 50)], []]
    graphs += [[tuple(sorted(rng.sample(range(40), 2))) for _ in range(n)] for n in (20, 60, 120)]
    for edges in graphs:
        gone = set()
        for v in range(201):
            if any(u not in gone for u, w in edges if w == v):
                gone.add(v)
        found = near_duplicates._dropped(spark.createDataFrame(edges, "early long, late long"))
        assert sorted(r["id"] for r in found.collect()) == sorted(gone)


def test_size_classes_hold_similar_sets():
    for threshold in (0.5, 0.8, 0.95):
        bounds = near_duplicates.size_classes(threshold)
        assert all(high > low / threshold for low, high in zip(bounds, bounds[1:]))


def nearest(index, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(queries) @ unit(index).T, retrieve.SCORE_PLACES)
    return {(q, int(c), r + 1) for q, line in enumerate(scores) for r, c in enumerate(np.lexsort((np.arange(len(line)), -line))[:k])}


@pytest.mark.parametrize("cells, blocks", [(None, (10_000, 10_000)), (1, (30, 4)), (40, (7, 4)), (150, (10_000, 3))])
def test_retrieval(spark, cells, blocks, monkeypatch):
    """The exact search equals a comparison with every row, however the rows are put into cells and blocks."""
    rng = np.random.default_rng(1)
    index, queries = rng.normal(size=(200, 8)), rng.normal(size=(9, 8))
    index[150:] = index[3]  # many equal vectors
    index[60:90] = index[60] + rng.normal(size=(30, 8)) * 0.01  # a narrow region
    queries[4] = index[61]
    schema = "long, vector array<double>"
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], f"chunk_id {schema}").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], f"query_id {schema}")
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", blocks[1])
    hits = retrieve.retrieve(chunks, asked, k=4, cells=cells)
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits.collect()} == nearest(index, queries, 4)


def test_retrieval_edges(spark):
    schema = "long, vector array<float>, extra int"
    rows = [(5, [1.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, None, 1), (8, [], 1), (9, [0.0, 2.0], 1), (10, [0.0, 0.0], 1), (11, [-1.0, 0.0], 1)]
    asked = [(1, [3.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1)]
    chunks, queries = spark.createDataFrame(rows, f"chunk_id {schema}"), spark.createDataFrame(asked, f"query_id {schema}")
    hits = retrieve.retrieve(chunks, queries, k=4).collect()
    found = {q: [(r["chunk_id"], r["score"]) for r in sorted(hits, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert found == {1: [(5, 1.0), (6, 0.0), (9, 0.0), (10, 0.0)], 2: [(5, 0.0), (6, 0.0), (9, 0.0), (10, 0.0)], 3: []}
    assert retrieve.retrieve(chunks.where("chunk_id = 7"), queries).collect() == []
    assert retrieve.retrieve(chunks, queries.limit(0)).collect() == []


def test_bounded_retrieval(spark):
    """Probing the nearest cells finds at least nine of ten of the true neighbours, and far cells are passed over by the exact search."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    index = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    queries = centres[rng.integers(0, 30, 40)] + rng.normal(size=(40, 16)) * 0.3
    schema = "long, vector array<double>"
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index)], f"chunk_id {schema}")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], f"query_id {schema}")
    built = vector_index.build_vector_index(chunks)
    exact, some = (
        {(r["query_id"], r["chunk_id"], r["rank"]) for r in vector_index.search(built, asked, k=5, probes=p).collect()} for p in (None, 4)
    )
    assert exact == nearest(index, queries, 5)
    assert len({h[:2] for h in exact} & {h[:2] for h in some}) >= 0.9 * len(exact)
    worst = spark.createDataFrame([(r[0], 0.8) for r in asked.select("query_id").collect()], "query_id long, worst double")
    asked_cells = vector_index._asked(asked.join(worst, "query_id"), built, 5, 2, True).count()
    assert asked_cells < 0.5 * 40 * len(built.centres)


def test_term_index(spark, monkeypatch):
    """All words count; the pruned search equals the full sums, also when lists are dealt to several keys."""
    rng = random.Random(6)
    names = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    texts = [" ".join(rng.choices(names, weights, k=rng.randint(0, 40))) for _ in range(150)] + [None, "", "W0, w1! w0?"]
    asked = [" ".join(rng.choices(names, weights, k=12)) for _ in range(20)] + ["unknown", "", None, "w0"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "chunk_id long, content string, term int").repartition(4)
    queries = spark.createDataFrame([(i, t, 1) for i, t in enumerate(asked)], "query_id long, content string, term int")
    counts = [collections.Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    df = collections.Counter(w for c in counts for w in c)
    idf = {w: round(1000 * math.log((len(texts) + 1) / (n + 1))) for w, n in df.items()}
    unit = lambda c: {w: n * idf.get(w, 0) / math.sqrt(sum((m * idf.get(v, 0)) ** 2 for v, m in c.items()) or 1) for w, n in c.items()}
    docs_by, want = [unit(c) for c in counts], set()
    for q, text in enumerate(asked):
        mine = unit(collections.Counter(re.findall(r"\w+", (text or "").lower())))
        scores = [(-round(sum(x * d.get(w, 0) for w, x in mine.items()), 9), i) for i, d in enumerate(docs_by)]
        want |= {(q, i, r + 1) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:5])}
    for hot in (1 << 16, 20):
        monkeypatch.setattr(term_index, "HOT_POSTINGS", hot)
        hits = term_index.search_terms(term_index.build_term_index(docs), queries, k=5).collect()
        assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits} == want


def test_term_vectors_need_no_shuffle(spark, monkeypatch):
    """The index holds a row per text, over several blocks; rows of one id are one text, and texts without id count once for each word."""
    monkeypatch.setattr(term_index, "BLOCK_BYTES", 8)
    texts = [(1, "b a b"), (2, "a c"), (2, "C d, c"), (None, "a e"), (None, "e"), (3, ""), (4, None), (5, "é 1é x_y")]
    rows = spark.createDataFrame(texts, "chunk_id long, content string")
    vectors = term_index.term_vectors(term_index.build_term_index(rows))
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    idf = {1: 1504.0, 2: 1099.0, 3: 811.0}  # by the number of texts, of nine
    assert {r["chunk_id"]: list(zip(r["terms"], r["vector"])) for r in vectors.collect()} == {
        1: [("a", idf[3]), ("b", 2 * idf[1])],
        2: [("a", idf[3]), ("c", 3 * idf[1]), ("d", idf[1])],
        5: [("1é", idf[1]), ("x", idf[1]), ("y", idf[1]), ("é", idf[1])],
    }


def test_text_retrieval_and_prompts(spark):
    texts = ["Machine learning finds patterns in data.", "The weather is sunny today.", "Cooking pasta takes ten minutes."]
    chunks = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], "doc_id long, content string, source_ref string, chunk_index int")
    model = retrieve.fit_text_vectors(chunks)
    index = retrieve.index_chunks(retrieve.text_vectors(model, chunks))
    asked = spark.createDataFrame([(0, "What is machine learning?")], "query_id long, content string")
    hits = retrieve.retrieve(index, retrieve.text_vectors(model, asked), k=2)
    context = retrieve.assemble_context(hits, index)
    prompts = spark.createDataFrame([(0, [("user", "hi")]), (1, [("user", "ho")])], "query_id long, messages array<struct<role:string,content:string>>")
    found = {r["query_id"]: r["messages"] for r in retrieve.prompts_with_context(prompts, context).collect()}
    assert found[0][0]["content"].startswith(retrieve.CONTEXT_PROMPT + texts[0]) and found[0][0]["content"].count("\n\n---\n\n") == 1
    assert [m["content"] for m in found[1]] == ["ho"]


def test_stream_equals_batch_and_resumes(spark):
    path = scratch_path(spark, "stream-test")
    rows = spark.createDataFrame([(i, f"Document number {i % 7} with some text.") for i in range(40)], "doc_id long, content string")
    seen = []
    for part in (0, 1):
        rows.where(F.col("doc_id") % 2 == part).repartition(2).write.mode("append").parquet(f"{path}/in")
        stream = streams.stream_files(spark, f"{path}/in", rows.schema, files_per_batch=1)
        cleaned = streams.chunk_stream(streams.clean_stream(stream))
        streams.process_batches(cleaned, lambda batch, n: seen.append((n, batch.count())), f"{path}/state")
    assert sum(n for _, n in seen) == 40 and len({i for i, _ in seen}) == 4


def test_stream_drops_repeats_over_batches(spark):
    path = scratch_path(spark, "stream-test")
    rows = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 5).cast("string")).alias("content"), F.timestamp_seconds("id").alias("ts")
    )
    rows.repartition(3).write.parquet(f"{path}/in")
    stream = streams.stream_files(spark, f"{path}/in", rows.schema, files_per_batch=1)
    kept = streams.drop_repeats(stream, time="ts", horizon="1 day", spread_by="doc_id", salts=4)
    streams.write_stream(kept, f"{path}/rows", f"{path}/state")
    assert sorted(r["content"] for r in spark.read.parquet(f"{path}/rows").collect()) == [f"text {i}" for i in range(5)]


def test_shared_dir_is_the_session_setting(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_pipeline(docs):
    texts = [
        "First document about shops.\n\nIt has two paragraphs that stay apart when chunks are made of them.",
        "Write to bob@example.com or call 555-1234 about the $99.99 plan, which is a fine plan.",
        "First document about shops.\n\nIt has two paragraphs that stay apart when chunks are made of them.",
    ]
    prepared = pipeline.prepare(docs(texts), max_chunk_size=60)
    assert prepared.chunks.where("doc_id = 0").count() == 2 and prepared.chunks.where("doc_id = 2").count() == 0
    assert {r["label"] for r in prepared.entities.collect()} == {"EMAIL", "MONEY"}
    assert prepared.records.count() == prepared.chunks.count()
    assert prepared.quality.first()["total_chunks"] == prepared.chunks.count()
