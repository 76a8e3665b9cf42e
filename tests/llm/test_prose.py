import numpy as np
import pytest

from trovework.llm import prose as P

EN = "The caller keeps a copy of the snapshot before the window is closed. This service reads the list twice after a restart. Nobody owns the old entries. "
DE = "Der Dienst liest die Daten zweimal nach jedem Neustart. Die Tabelle wartet auf den nächsten Block für ältere Programme. Jeder Eintrag wird gelöscht. "
RU = "Этот сервис читает данные два раза после каждого перезапуска. Очередь удаляет все устаревшие строки. "
JA = "検索ノードは接続が切れた場合に次のブロックを待ちます。このサービスは古い行を削除します。"
CODE = "int f(int a) { return g(a, 3) + b[i]; }\nvar x = foo.bar(y);\nif (x == 4) { y = x * 2; }\nSELECT a, b FROM c WHERE d = ?\n"


@pytest.fixture(scope="module")
def model():
    return P.train({0: [EN * 40], 1: [DE * 40], 5: [RU * 40], 6: [JA * 60], P.CODE: [CODE * 40]})


def decode_slowly(model, text):
    """The same model, by the plain algorithm over all pairs of states."""
    row, table = model
    r = P._rows(row, text)
    cost = np.where(np.eye(table.shape[0], dtype=bool), 0.0, P.CHANGE)
    score, back = table[:, r[0]].astype(np.float64), []
    for i in r[1:]:
        all_ = score[:, None] - cost
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0) + table[:, i]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_by_brute_force(model):
    text = CODE[:60] + "// " + EN[:60] + "\n" + CODE[:40] + DE[:80]
    fast = P.states(model, [text])
    slow = np.array(decode_slowly(model, text))
    assert (fast == slow).mean() > 0.99  # ties may differ


def test_states_do_not_depend_on_the_other_texts(model, monkeypatch):
    texts = [CODE[:60] + "// " + EN[:60], "", DE[:80], CODE * 40 + EN * 30, "x"]
    alone = np.concatenate([P.states(model, [t]) for t in texts])
    assert (P.states(model, texts) == alone).all() and (P.states(model, texts[::-1])[::-1].shape == alone.shape)
    monkeypatch.setattr(P, "CELLS", 3000)
    assert (P.states(model, texts) == alone).all()
    long = texts[3]
    monkeypatch.setattr(P, "LENGTH", 1 << 20)
    whole = P.states(model, [long])
    monkeypatch.setattr(P, "LENGTH", 256)
    assert (P.states(model, [long]) == whole).mean() > 0.999


def test_long_text_in_pieces(model):
    s = P.states(model, [(EN * 50) + (CODE * 50)])
    n = len(EN) * 50
    assert (s[:n] == 0).mean() > 0.95 and (s[n:] == P.CODE).mean() > 0.95


TABLE = "id string, content string, source_file string, language string, start int"


def test_found(spark, model):
    rows = [
        ("a", "// The caller keeps a copy of the snapshot\n// before the window is closed.\nint x = 1;\n", "a.c"), ("b", 's = "Der Dienst liest die Daten zweimal nach jedem Neustart."\n', "b.py"),
        ("c", "# x = foo(bar)\n# y = x * 2\n", "c.py"), ("d", 'q = "SELECT a, b FROM c WHERE d = ?"', "d.py"), ("e", "# Этот сервис читает данные два раза\nkey: The caller keeps a copy of it\n", "e.yml"),
        ("f", "x = 1;  // 検索ノードは接続が切れた場合に次のブロックを待ちます。", "f.js"), ("g", "// short one", "g.js"), ("h", None, "h.py"), ("i", "", "i.py"), ("j", 'x = "Der Dienst liest die n\\u00e4chsten Daten zweimal"', "j.go"),
    ]
    df = spark.createDataFrame([(i, t, p, None, 1) for i, t, p in rows] + [("a", rows[0][1], "a.c", None, 2)], TABLE)
    out = P.find_prose(df, model)
    assert sorted((r["id"], r["line_no"], r["prose_lang"]) for r in out.collect()) == [("a", 1, "en"), ("b", 1, "de"), ("e", 1, "ru"), ("f", 1, "ja"), ("j", 1, "de")]
    share = {(r["source_file"], r["prose_lang"]): r["share"] for r in P.shares(df, out).collect()}
    assert 0.8 < share["a.c", "en"] < 1
    assert P.find_prose(df.limit(0), model).count() == 0


def test_clauses_stop_at_sentence_ends(model):
    assert P._STOP.split("Code made by it. Do not edit.") == ["Code made by it", "Do not edit."]
