import duckdb

from overlook.llm import chat_format as op

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    held = {}
    for c, t, r, x in rows:
        if c is not None:
            held.setdefault(c, set()).add((t is not None, t or 0, r if r is not None else "unknown", x or ""))
    chats = {c: tuple(k[2:] for k in sorted(v)) for c, v in held.items()}
    return {c for c, v in chats.items() if not any(d != c and (w[: len(v)] == v and (len(w) > len(v) or d < c)) for d, w in chats.items())}


def test_whole_table_against_sql_and_brute_force(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = duckdb.sql(op.ORACLE).fetchall()
    got = [(r.conv_id, r.n_turns, r.rendered_sha256, r.n_chars) for r in op.query(spark, sf_dir).select("conv_id", "n_turns", "rendered_sha256", "n_chars").collect()]
    assert sorted(got) == sorted(want)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {g[0] for g in got} == brute(rows)


def test_snapshots_copies_and_awkward_rows(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "bye"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no")]
    rows += [(6, None, None, None), (6, None, None, None), (7, 0, "user", f"mark {op.CLOSE}"), (None, 0, "user", "lost"), (8, 0, "", "userx"), (9, 0, "user", "x")]
    rows += [(10, i, "user", "long " * 200) for i in range(300)] + [(11, i, "user", "long " * 200) for i in range(299)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in op.format_chats(df.withColumn("chain", df.text).withColumn("last", df.text)).collect()}
    assert set(out) == brute(rows) == {3, 4, 6, 7, 8, 9, 10}
    assert out[6].n_turns == 1 and out[10].n_turns == 300 and out[7].rendered.count(op.CLOSE) == 1
    assert out[3].rendered == "".join(f"{op.OPEN}{r}\n{t}{op.CLOSE}\n" for r, t in (("user", "hi"), ("assistant", "yo"), ("user", "bye")))
    assert op.format_chats(df.limit(0)).collect() == []


def test_prefix_hashes_tell_order_place_and_length(spark):
    """Equal hashes where, and only where, the turns so far are equal."""
    chats = {1: "abcd", 2: "abdc", 3: "abcda", 4: "abab", 5: "aabb", 6: "bb"}
    df = spark.createDataFrame([(c, i, "user", x) for c, xs in chats.items() for i, x in enumerate(xs)], SCHEMA)
    found = {}
    for r in op.prefixes(op.conversations(df)).collect():
        found.setdefault((r.k, r.a, r.b), set()).add(chats[r.conv_id][: r.k])
    assert all(len(v) == 1 for v in found.values())
    assert len(found) == len({xs[:k] for xs in chats.values() for k in range(1, len(xs) + 1)})


def test_many_turns_take_time_in_proportion(spark):
    """50,000 turns, a fifth of them repeated rows; four times the turns take far less than sixteen times as long."""
    import time

    def run(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
        began = time.time()
        out = op.format_chats(rows.union(rows.where("turn % 5 = 0"))).selectExpr("n_turns", "length(rendered) AS n").collect()
        assert [r.n_turns for r in out] == [n]
        return time.time() - began

    run(1000)
    short, long = run(12_500), run(50_000)
    assert long < 8 * short + 2
