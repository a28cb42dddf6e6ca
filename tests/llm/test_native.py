"""Fingerprints, line dedup and chat formatting against plain versions."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from opinionweave.llm import chat_tools, line_dedup, merkle

MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_edited_text_and_likeness(docs_of):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé𝄞\n ") for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", "ab", "x" * 5000]
    ids = rng.sample(range(-50, 1000), len(texts))
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
    got = merkle.document_fingerprints(docs_of(list(zip(ids, texts, strict=True)))).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    text_of = dict(zip(ids, texts, strict=True))
    for a in got:
        for b in got:
            same = (text_of[a["doc_id"]] or "") == (text_of[b["doc_id"]] or "")
            assert (a["fingerprint"].split("/")[0] == b["fingerprint"].split("/")[0]) == same


def test_differing_paragraphs(spark):
    a = "\n".join(f"paragraph {i}" for i in range(30))
    b = a.replace("paragraph 3\n", "other\n").replace("paragraph 20", "paragraph 20 and more")
    df = spark.createDataFrame([(a, b), (a, a), (a, a + "\nnew")], "a string, b string")
    prints = df.select(merkle.fingerprint(merkle.leaves(F.col("a"))).alias("x"), merkle.fingerprint(merkle.leaves(F.col("b"))).alias("y"))
    got = prints.select(merkle.differing_paragraphs(F.col("x"), F.col("y")).alias("d")).collect()
    assert [r["d"] for r in got] == [[3, 20], [], [30]]


def test_merkle_of_one_row_and_ties(docs_of):
    one = merkle.document_fingerprints(docs_of(["abcdef"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    rows = merkle.document_fingerprints(docs_of([(1, "aaa"), (1, "aaa"), (1, "bbb"), (None, "ccc")])).collect()
    assert sorted(r["edited_sha256"] for r in rows) == sorted(hashlib.sha256(t).hexdigest() for t in (b"aaa", b"aab", b"bbc", b"cca"))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_kept(rows, least):
    lines = [(i, k, tuple(x for x in line.replace("\t", " ").split(" ") if x)) for i, t in sorted(rows) for k, line in enumerate((t or "").split("\n"))]
    kept = {i: [] for i, _ in rows}
    for n, (i, k, words) in enumerate(lines):
        earlier = [w for _, _, w in lines[:n]]
        if not words or not any(w == words or (len(w) >= least and len(words) >= least and one_edit(w, words)) for w in earlier):
            kept[i].append(k)
    return kept


def test_lines_are_split_once_to_compare(spark):
    lines = [("a b c", "a x c"), ("a b c", "a c"), ("b c", "a b c"), ("a b", "a b c"), ("a b c", "c b a"), ("a b", "a b"), ("a b", "a b c d"), ("a a a", "a a")]
    df = spark.createDataFrame(lines, "line string, other string")
    near = df.withColumn("near", line_dedup._lines_one_edit(F.col("line"), F.col("other")))
    assert [r["near"] for r in near.collect()] == [True, True, True, True, False, True, False, True]
    plan = near.filter("near")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(other#") == 2  # once to filter, once to show
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d x f g h i")], "doc_id bigint, text string")
    rows = line_dedup.with_row_key(docs, "doc_id", "text")
    plan = line_dedup.neighbours(rows, line_dedup.distinct_lines(rows, "doc_id", "text", 4), "doc_id", "text", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(other#") == 1


def test_line_dedup(docs_of):
    rng = random.Random(2)
    pool = [[rng.choice("abcde") for _ in range(rng.randint(0, 7))] for _ in range(25)]

    def line():
        words = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randint(0, len(words))
            what = rng.randint(0, 2)
            if what == 0:
                words.insert(at, rng.choice("abcde"))
            elif words and at < len(words):
                words[at : at + 1] = [rng.choice("abcde")] if what == 1 else []
        return rng.choice([" ", "  ", "\t"]).join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, "")]
    want = plain_kept(rows, 4)
    got = line_dedup.dedup_lines(docs_of(rows), min_words=4).collect()
    text = dict(rows)
    for r in got:
        assert r["kept"] == want[r["doc_id"]]
        lines = (text[r["doc_id"]] or "").split("\n")
        assert r["text"] == "\n".join(lines[k] for k in r["kept"]) and r["n_lines"] == len(lines)
    brief = {r["doc_id"]: r for r in line_dedup.line_decisions(docs_of(rows), min_words=4).collect()}
    assert all(brief[i]["kept_lines"] == ",".join(map(str, k)) for i, k in want.items())


def call(i, name="answer", after=None, **args):
    return json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args | ({} if after is None else {"after": after})}]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def chats(spark, rows):
    schemas = spark.createDataFrame(chat_tools.SCHEMAS, "tool string, name string, type string, required boolean")
    return {r["conv_id"]: r for r in chat_tools.format_chats(spark.createDataFrame(rows, MESSAGES), schemas).collect()}


def test_calls_link_order_and_validate(spark):
    good = {"question": "q", "turn": 1}
    got = chats(spark, [
        (1, 0, "system", "be \"kind\""), (1, 1, "assistant", call("b", after="a", **good)), (1, 2, "assistant", call("a", **good)),
        (1, 3, "tool", result("a", {"z": 1, "y": [1.50, None]})), (1, 4, "tool", result("gone", 1)), (1, 5, "user", None),
        (2, 0, "assistant", call("a", turn="x", extra=1)), (2, 1, "assistant", call("a", **good)), (2, 2, "assistant", call("n", name="none")),
        (2, 3, "tool", result("a", "first")), (2, 4, "tool", result("a", "second")), (2, 5, "assistant", "{not json"),
        (3, 0, "assistant", call("x", after="y", **good)), (3, 1, "assistant", call("y", after="x", **good)), (3, 2, "assistant", call("z", after="y", **good)),
        (None, 0, "user", "hello"), (None, 0, "user", "hello"),
    ])
    first = json.loads(got[1]["chat"])["messages"]
    assert [m.get("id", m.get("role")) for m in first] == ["system", "a", "b", "tool", "user"]
    assert first[3] == {"content": 1, "orphan": True, "role": "tool", "tool_call_id": "gone"}
    assert first[1]["result"] == {"y": [1.5, None], "z": 1} and "violations" not in first[1]
    assert '{"arguments":{"question":"q","turn":1},"id":"a","name":"answer","result":{"y":[1.5,null],"z":1}}' in got[1]["chat"]
    assert (got[1]["n_calls"], got[1]["n_linked"], got[1]["n_orphans"], got[1]["n_invalid"]) == (2, 1, 1, 0)
    second = json.loads(got[2]["chat"])["messages"]
    assert second[0]["violations"] == ["missing:question", "type:turn", "unknown:extra"] and second[0]["result"] == "first"
    assert second[1]["violations"] == ["repeated_id"] and second[2]["violations"] == ["unknown_tool"]
    assert second[3] == {"content": "second", "orphan": True, "role": "tool", "tool_call_id": "a"}
    assert second[4] == {"content": "{not json", "role": "assistant"}
    assert (got[2]["n_calls"], got[2]["n_linked"], got[2]["n_orphans"], got[2]["n_invalid"]) == (3, 1, 1, 3)
    assert all(m["violations"] == ["cycle"] for m in json.loads(got[3]["chat"])["messages"])
    assert got[None]["n_messages"] == 2 and got[None]["chat"].count("hello") == 2


def test_nothing_is_lost_or_squared(spark):
    """Copies of a call, results of one turn, words beside calls, empty lists of calls, null turns."""
    good = {"question": "q", "turn": 1}
    talk = json.dumps({"content": "let me see", "tool_calls": json.loads(call("t", **good))["tool_calls"]})
    got = chats(spark, [
        (1, 0, "assistant", call("a", **good)), (1, 0, "assistant", call("a", **good)), (1, 1, "assistant", call("b", after="a", **good)),
        (2, 0, "assistant", talk), (2, 1, "tool", result("t", "y")), (2, 1, "tool", result("t", "x")), (2, 1, "tool", result("t", "x")),
        (3, 0, "assistant", '{"tool_calls": []}'), (3, 1, "tool", result("none", "kept")), (3, None, "tool", result("none", None)),
    ])
    first = json.loads(got[1]["chat"])["messages"]
    assert (got[1]["n_messages"], got[1]["n_calls"], got[1]["n_invalid"]) == (3, 3, 1)
    assert [(m["id"], m.get("violations")) for m in first] == [("a", None), ("a", ["repeated_id"]), ("b", None)]
    second = json.loads(got[2]["chat"])["messages"]
    assert second[0] == {"content": "let me see", "role": "assistant"} and second[1]["result"] == "x"
    assert [m["content"] for m in second[2:]] == ["x", "y"] and (got[2]["n_linked"], got[2]["n_orphans"]) == (1, 2)
    third = json.loads(got[3]["chat"])["messages"]
    assert [m.get("content") for m in third] == [None, '{"tool_calls": []}', "kept"] and got[3]["n_orphans"] == 2


def test_conversations_named_by_text(spark):
    schemas = spark.createDataFrame(chat_tools.SCHEMAS, "tool string, name string, type string, required boolean")
    rows = spark.createDataFrame([("x", 0, "user", "hi"), ("", 0, "user", "hi"), (None, 0, "user", "hi")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["n_messages"] for r in chat_tools.format_chats(rows, schemas).collect()} == {"x": 1, "": 1, None: 1}


def test_long_chain_is_ordered(spark):
    """Every call waits for one that was written later: the order is the reverse of the turns."""
    n = 40
    rows = [(7, t, "assistant", call(str(t), after=str(t + 1) if t + 1 < n else None, question="q", turn=t)) for t in range(n)]
    got = chats(spark, rows)[7]
    assert [m["id"] for m in json.loads(got["chat"])["messages"]] == [str(t) for t in reversed(range(n))]
    assert got["n_invalid"] == 0


def test_odd_rows(spark, odd_docs, no_docs):
    for run in (merkle.document_fingerprints, line_dedup.dedup_lines, line_dedup.line_decisions):
        assert len(run(odd_docs).collect()) == 10
        assert run(no_docs).collect() == []
    assert chats(spark, []) == {}
    extra = chat_tools.calls_from_turns(spark.createDataFrame([(1, 0, None, None), (None, None, "user", "x")], MESSAGES).withColumn("calls", F.lit(1)))
    schemas = spark.createDataFrame([], "tool string, name string, type string, required boolean")
    assert len(chat_tools.format_chats(extra, schemas).collect()) == 2


def test_chats_equal_sql_on_odd_turns(spark):
    """Conversations that open with an assistant, or hold two assistants or two users in a row."""
    import duckdb

    from opinionweave.llm import oracles

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant"]), rng.choice(["hi", "é \"x\"", "", None])) for c in range(40) for t in range(rng.randint(1, 9))]
    schemas = spark.createDataFrame(chat_tools.SCHEMAS, "tool string, name string, type string, required boolean")
    got = chat_tools.format_chats(chat_tools.calls_from_turns(spark.createDataFrame(rows, MESSAGES)), schemas).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(oracles.CHATS).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r["n_orphans"] for r in got) > 0
