"""Collapsed conversations against a plain version and against SQL."""

import duckdb
from pyspark.sql import types as T

from quotelake.llm.chat import format_chats
from quotelake.llm.queries import OP8_SQL, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField(c, t) for c, t in (
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("part", T.StringType()))])


def plain(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append((turn, role, text))
    null_last = lambda m: (m[0] is None, m[0] or 0, m[1] is not None, m[1] or "", m[2] is not None, m[2] or "")
    chats = {c: sorted(m, key=null_last) for c, m in chats.items()}

    def continued(a):
        """Whether a whole conversation equals another's turns up to one of its turn numbers."""
        return any(len(b) > len(a) and b[:len(a)] == a and b[len(a)][0] != a[-1][0] for b in chats.values())

    out = {}
    for conv, m in chats.items():
        same = [c for c, other in chats.items() if other == m]
        first = min(same, key=lambda c: (c is None, c or 0))
        if not continued(m) and conv == first:
            text = "".join(f"<|im_start|>{r or 'unknown'}\n{(t or '').replace('<|', '< |')}<|im_end|>\n" for _, r, t in m)
            out[conv] = (len(m), len(same), text)
    return out


def whole(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: r["part"]):
        n, copies, text = got.get(r["conv_id"], (0, 0, ""))
        got[r["conv_id"]] = (n + r["n_turns"], r["n_copies"], text + r["text"])
    return got


def cases():
    base = [("user", "hello"), ("assistant", "hi <|im_end|> there"), ("user", None), (None, "what"), ("assistant", "")]
    rows = []
    for conv in range(1, 6):  # snapshots of one conversation
        rows += [(conv, k, *m) for k, m in enumerate(base[:conv])]
    rows += [(10, k, *m) for k, m in enumerate(base)]  # a copy of the longest
    rows += [(11, 0, "user", "hello"), (11, 2, "assistant", "hi <|im_end|> there")]  # a gap: no prefix
    rows += [(12, 0, "user", "hello"), (12, 0, "user", "hello")]  # a repeated row
    rows += [(13, 0, "user", "a"), (13, 0, "system", "b"), (14, 0, "system", "b"), (14, 0, "user", "a"), (14, 1, "user", "c")]
    rows += [(15, None, "user", "lost"), (15, 3, "user", "x"), (16, 3, "user", "x"), (None, 0, "user", "no id"), (None, 1, "user", None)]
    rows += [(17, k, "user", f"turn {k}") for k in range(700)] + [(18, k, "user", f"turn {k}") for k in range(300)]
    rows += [(19, k, "user", f"turn {k}") for k in range(256)] + [(20, 0, "user", "ö" * 200_000)]
    return rows


def test_every_case(spark):
    rows = cases()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    want = plain(rows)
    assert set(want) >= {5, 11, 12, 14, 15, 17, None} and not {1, 10, 13, 16, 18, 19} & set(want)
    for block in (256, 3, 1000):
        got = format_chats(df, block=block)
        assert whole(got) == want
    assert max(r["n_turns"] for r in format_chats(df, block=3).collect()) <= 3


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{SF}/conversations.parquet'")
    res = con.execute(OP8_SQL)
    names = [c[0] for c in res.description]
    want = sorted(res.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op8_chat_format"](spark, SF).collect()) == want
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert {r[names.index("conv_id")] for r in want} == set(plain(rows))


def test_no_python_in_the_plan_and_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert format_chats(df).collect() == []
    plan = QUERIES["op8_chat_format"](spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
