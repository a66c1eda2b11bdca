"""The script parser and the packer by hand-made cases and properties."""

import itertools

from corpusmill.functions import text as T
from corpusmill.operators import grep as G
from corpusmill.operators import retrieval as R
from corpusmill.operators import scripts as S
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

SCRIPT = '''/// ===== Inputs =====
/// of the month

const region = "north"
read "/in/{region}/items.csv" as Items with
  Id : text
  Qty : number
// a note

// another
Items.Total = sum(
  Items.Qty,
Other.Rate)
Note = """two
lines"""
show table "Totals" with
  Items.Total
'''


def test_blocks():
    blocks = S.parse_script(SCRIPT)
    assert [(b["block_type"], b["name"], b["line_start"], b["line_end"]) for b in blocks] == [
        ("section_header", "Inputs", 1, 2), ("const", "region", 4, 4), ("read", "Items", 5, 7), ("comment", None, 8, 10),
        ("assignment", "Items", 11, 13), ("assignment", "Note", 14, 15), ("show", "Totals", 16, 18),
    ]
    assert blocks[2]["dependencies"] == ["region"] and blocks[2]["definitions"] == ["Items"]
    assert blocks[3]["content"] == "// a note\n// another" and blocks[4]["dependencies"] == ["Items", "Other"]


def test_odd_scripts():
    assert S.parse_script("") == [] and S.parse_script("\n \n\r\n") == []
    assert len(S.parse_script('a = """open\nnever closed')) == 1
    assert S.parse_script("((((\n))))\nread \"x\" as Y")[1]["block_type"] == "read"


@given(st.lists(st.sampled_from(["", "  x", "a = 1", "read \"p\" as T with", "// c", "/// ~~~~ h", "f(", ")", '"""', "where x"]), max_size=30))
def test_blocks_cover_all_lines_once(lines):
    blocks = S.parse_script("\n".join(lines))
    taken = list(itertools.chain.from_iterable(range(b["line_start"], b["line_end"] + 1) for b in blocks))
    assert len(taken) == len(set(taken)) and taken == sorted(taken)
    assert all(not lines[i].strip() for i in range(len(lines)) if i + 1 not in taken)


@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=60), st.integers(0, 2))
def test_chunks_keep_the_bound(blocks, overlap):
    chunks = S.pack_blocks(blocks, 50, overlap)
    assert [i for a, b, _, _ in chunks for i in range(a, b + 1)] == list(range(len(blocks)))
    for a, b, size, again in chunks:
        assert size == sum(n for n, _ in blocks[a : b + 1]) + again and (size <= 50 or a == b)


@given(st.lists(st.tuples(st.integers(0, 60), st.booleans()), max_size=60), st.integers(0, 3))
def test_overlap_is_the_end_of_the_chunk_before(blocks, overlap):
    """What is repeated are the last blocks of the chunk before, small ones only, never a full chunk, and none after a header."""
    from corpusmill.operators import chunks as C

    before = None
    for a, b, _, low, again in C.pack([(n, h, 1, False) for n, h in blocks], 50, overlap):
        assert again == sum(n for n, _ in blocks[low:a]) and a - low <= min(3, overlap)
        assert all(n <= 10 for n, _ in blocks[low:a])
        if a > low:
            assert low >= before[3] and b >= a and not blocks[a][1] and not blocks[a - 1][1]
        before = (a, b, None, low)


@given(st.lists(st.integers(0, 40), min_size=1, max_size=80), st.integers(0, 3))
def test_split_lines(sizes, overlap):
    """Parts cover all lines in order; all but a single long line hold the bound, and the last is filled up if it can be."""
    from corpusmill.operators import chunks as C

    parts = C.split_lines(sizes, 100, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(sizes) and {i for a, b in parts for i in range(a, b)} == set(range(len(sizes)))
    assert all(a <= c <= b < d for (a, b), (c, d) in itertools.pairwise(parts))
    for a, b in parts[:-1]:
        assert sum(sizes[a:b]) <= 70 or sum(sizes[a : b - 1]) <= 70 or b - a <= overlap + 1
    a, b = parts[-1]
    assert len(parts) == 1 or sum(sizes[a:b]) >= 40 or a == 0 or sum(sizes[a - 1 : b]) > 100


def test_script_chunks_of_a_large_block(spark):
    """A block over the bound is split into parts that overlap; each names what it holds of the block's dependencies."""
    from corpusmill.operators import chunks as C

    text = "/// ==== Top ====\nItems.Total = sum(\n" + "\n".join(f"  Orders{i}.Price * {i} +" for i in range(60)) + "\n  0)\nshow table \"T\" with\n  Items.Total"
    chunks = C.chunk_blocks(S.parse_script(text), 128, 2)
    assert all(c["section"] == "Top" for c in chunks) and len(chunks) > 3 and not any(c["oversize"] for c in chunks)
    assert {w for c in chunks for w in c["dependencies"]} == {"Items"} | {f"Orders{i}" for i in range(60)}
    for c in chunks:
        assert all(w in c["content"] for w in c["dependencies"]) and len(c["content"]) // 3 >= c["tokens"] - 3
    covered = {i for c in chunks for i in range(c["line_start"], c["line_end"] + 1)}
    assert covered == set(range(1, text.count("\n") + 2))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in C.chunk_scripts(df, 128, 2).select("chunk_no", "tokens").collect()] == [(c["chunk_no"], c["tokens"]) for c in chunks]
    long_line = C.chunk_blocks(S.parse_script("x = " + "1" * 2000), 128, 2)
    assert [c["oversize"] for c in long_line] == [True]


@given(st.text(alphabet="ab \n", max_size=400), st.integers(0, 3))
def test_generic_chunks(text, keep):
    from corpusmill.operators import chunks as C

    out = C.generic_chunks(text, 20, keep)
    lines = text.split("\n")
    at = 0
    for c in out:
        own = c.split("\n")
        at = next(i for i in range(max(0, at - keep), len(lines)) if lines[i : i + len(own)] == own) + len(own)
        assert len(c) // 4 <= 20 or len(own) == 1
    assert out[-1].split("\n")[-1] == lines[-1]


def test_table_references():
    code = 'Items.Total + Orders * max(Vendors.Price) // Hidden.Field and Commented\n  Total : Money\nread x as Alias\nPlain = Other + N + Id + "Quoted.Field"'
    assert S.table_references(code) == {"Items", "Orders", "Vendors", "Hidden", "Other"}
    assert S.interpolations("#(region) #(Orders.Line) #(sum) #(x)") == {"region", "Orders"}


def test_constants_resolve(spark):
    df = spark.createDataFrame([(1, 'const a = "x{b}"\nconst b = "{c}"\nconst c = "end"\nread "/{a}/{zz}/f"', "/p")], "doc_id long, text string, path string")
    m = S.constants(F.col("text"))
    assert df.select(S.resolved(F.lit("{a}-{zz}"), m)).first()[0] == "xend-{zz}"
    assert df.select(S.resolved(F.lit("{a}-{zz}"), m, unknown="erase")).first()[0] == "xend-"
    assert S.references(df).select("target").first()[0] == "/xend/*/f"


def test_paths(spark):
    rows = [("a\\b//c", "/a/b/c"), ("[ 12 ]/x", "/[ X ]/x"), ("plain", "plain"), ("f.csv", "/f.csv")]
    out = spark.createDataFrame(rows, "raw string, want string").select(T.normalized_path(F.col("raw")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in out)
    once = spark.createDataFrame(rows, "raw string, want string").select(T.normalized_path(T.normalized_path(F.col("raw"))).alias("twice"), "want").collect()
    assert all(r["twice"] == r["want"] for r in once)


def test_globs(spark):
    out = spark.createDataFrame([("/a/*.csv", "/a/b.csv", True), ("/a/?.csv", "/a/bb.csv", False), ("/[ X ]/*", "/[ X ]/q", True), ("/a.b", "/axb", False)], "g string, f string, want boolean")
    assert all(r["got"] == r["want"] for r in out.withColumn("re", T.glob_regex(F.col("g"))).select(F.expr("f rlike re").alias("got"), "want").collect())


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc_id long, rank int")
    b = spark.createDataFrame([(3, 1), (4, 2)], "doc_id long, rank int")
    x, y = (sorted(map(tuple, R.fuse(s, 10).collect())) for s in ([a, b], [b, a]))
    assert x == y and x[2][0] == 3 and max(x, key=lambda r: r[1])[0] == 3


def test_vectors_without_length(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 1").selectExpr("vec_id as query_id", "embedding as query")
    assert [(r["vec_id"], r["score"]) for r in R.dense_search(v, q, 3).orderBy("rank").collect()] == [(2, 1.0), (0, 0.0), (3, -1.0)]


def test_context_size_matches_a_plain_search(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(40):
        n = r.randint(1, 400)
        rows.append((i, n, sorted(r.sample(range(1, n + 1), r.randint(1, min(n, 12))))))
    got = {x["i"]: x["k"] for x in spark.createDataFrame(rows, "i int, n int, ms array<int>").select("i", G.context_size(F.col("ms"), F.col("n")).alias("k")).collect()}
    for i, n, ms in rows:
        def total(k, n=n, ms=ms):
            seen = sorted({x for m in ms for x in range(max(1, m - k), min(n, m + k) + 1)})
            return len(seen) + sum(1 for a, b in itertools.pairwise(seen) if b > a + 1)

        best = 0  # the search as it is stated: upwards from 1, to the first that is too large or no larger than the one before
        if total(0) <= 150:
            for k in range(1, 201):
                if total(k) > 150:
                    break
                best = k
                if k > 1 and total(k) == total(k - 1):
                    break
        assert got[i] == best, (n, ms)


def test_bad_pattern_is_literal(spark):
    docs = spark.createDataFrame([(1, "a (b\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(x) for x in G.grep_lines(docs, "(b").collect()] == [(1, 1, "a (b")]


def test_grep_with_anchors(spark):
    """A line is found by its own start and end, wherever it stands in the text."""
    from corpusmill.operators import grep

    docs = spark.createDataFrame([(1, "first\nimport a\nlast"), (2, "the end\nmore"), (3, "no\nkey\n")], "doc_id long, text string")
    hits = {p: sorted((r["doc_id"], r["line_no"]) for r in grep.grep_lines(docs, p).collect()) for p in ("^import", "end$", r"key(?!\s)", r"\Aimport", "a$", "more")}
    assert hits == {"^import": [(1, 2)], "end$": [(2, 1)], r"key(?!\s)": [(3, 2)], r"\Aimport": [(1, 2)], "a$": [(1, 2)], "more": [(2, 2)]}
    assert [r["line_no"] for r in grep.with_context(docs, "^import", 0).collect()] == [2]
