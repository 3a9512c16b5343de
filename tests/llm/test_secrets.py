import hashlib
import random

import pytest

from tests.llm import cases
from tidemark.llm import secret_scan as ss

WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def lower(c):
    return c.lower() if c.isascii() else c


def plain(text):
    """The base spans, character by character."""
    low = "".join(map(lower, text))
    out, i = [], 0
    while i < len(text):
        word = next((w for w in WORDS if low.startswith(w, i)), None)
        end = None
        if word:
            j = i + len(word)
            for quote in ([1, 0] if text[j:j + 1] in ('"', "'") and text[j:j + 1] else [0]):
                k = j + quote
                while text[k:k + 1] == " ":
                    k += 1
                if text[k:k + 1] in (":", "=") and text[k:k + 1]:
                    k += 1
                    while text[k:k + 1] == " ":
                        k += 1
                    k += text[k:k + 1] in ('"', "'") and text[k:k + 1] != ""
                    e = k
                    while e < len(text) and text[e] in VALUE:
                        e += 1
                    if e > k:
                        end = (e, e - k)
                        break
        if end:
            if end[1] >= 8:
                out.append((i, end[0], 0))
            i = end[0]
        else:
            i += 1
    for kind, head, chars, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
        i = 0
        while i < len(text):
            e = i + len(head) if text.startswith(head, i) else i
            while (e > i or not head) and e < len(text) and text[e] in chars:
                e += 1
            if e - i >= least:
                out.append((i, e, kind))
            i = max(e, i + 1)
    return sorted(out, key=lambda s: (s[0], s[2]))


SHORT = ["token:ab token:abcdefgh", "secret=token:abcdefghij", "TOKEN = 'abcdefgh'", "toKen=abcdefgh", "paſsword=abcdefgh",
         "api_key\"  : \"0123456789abcdef0123456789abcdef\"", "AKIAABCDEFGHIJKL AKIAABC AKIAAKIAABCDEFGHIJ", "f" * 31 + " " + "f" * 32,
         "é🙂 password: \"Abc/+=._-9\" x", "password=password=password=", "apikey:=12345678", "token", "token=", "token: : abcdefgh",
         "password\n=abcdefgh", "xsecrets=abcdefgh", "AKIA", "secret=abcdefg", "passwd = \"secret: abcdefghi"]


def base_of(text):
    return [(a, b, k) for a, b, k, *_ in ss.scan_text(text) if k < 3]


@pytest.mark.parametrize("text", SHORT)
def test_base_spans(text):
    assert base_of(text) == plain(text)


def test_base_spans_of_random_texts():
    rng = random.Random(9)
    parts = WORDS + ["=", ":", " ", "\"", "'", "AKIA", "ABCDEF0123", "0f" * 9, "abcdefgh", "Z", "\n", "ſ", "TOKEN", "Api_Key", ".", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert base_of(text) == plain(text), text


#: text -> the literals that the method must add
ADDED = {
    'KEY = "zQ81-xx9Lm2"\nclient = connect(api_key=KEY)': ["zQ81-xx9Lm2"],
    'FIRST = "kd83Jd92"\nSECOND = FIRST\nlogin(user="bob", password=SECOND)': ["kd83Jd92"],
    'db_password = "hunt3r!"': ["hunt3r!"],
    'private String clientPwd = "Tr0ub4dor&3";': ["Tr0ub4dor&3"],
    'auth_key: str = "a8#kf02!x"': ["a8#kf02!x"],
    '{"privateKey": "q9$w8*e7!r", "user": "someone"}': ["q9$w8*e7!r"],
    'os.environ["ACCESS_KEY"] = "n7!bv5?cx"': ["n7!bv5?cx"],
    "export DB_PWD=s3cr3tv4lue\nexport USER=bob": ["s3cr3tv4lue"],
    "  signing-key: 9f8e7d6c5b4a\n": ["9f8e7d6c5b4a"],
    "<dbPassphrase>l0ngpa55!</dbPassphrase>": ["l0ngpa55!"],
    "mysql --host db --pwd Zx81_cv42": ["Zx81_cv42"],
    'conf.setPassphrase("m9n8b7v6")': ["m9n8b7v6"],
    'headers.put("X-Private-Key", "0a9s8d7f")': ["0a9s8d7f"],
    'A = "p4rt-one"\nB = A + "-p4rt-two"\nsecret_key = B': ["p4rt-one", "-p4rt-two"],
    'authorization = b64decode("dXNlcjpwYXNz1")': ["dXNlcjpwYXNz1"],
    'V1="r3al-val-9"\npassphrase="${V1}"': ["r3al-val-9"],
    'use(secretKey = LATER)\nLATER = "w8x7y6z5"': ["w8x7y6z5"],
}
CLEAN = ['password_field = "pwd_input1"', 'token_count = "12345abc"', 'max_tokens = 4096', "password: see the manual", 'greeting = "h3llo-w0rld9"',
         'passphrase = "your-key-here1"', 'private_key = "/etc/ssl/key1.pem"', 'if pwd == "abc123xyz": pass', "don't share the key, it's ours",
         'pwd = get_pwd("vault1a")', 'credential = "https://x.y/z1"', "The secret was told: nobody knew 12ab34.", 'KEY = KEY2\nKEY2 = KEY\npwd = KEY',
         "key: v4lue99x", cases.PROSE]


@pytest.mark.parametrize("text", list(ADDED))
def test_method_adds_literals(text):
    got = [text[a:b] for a, b, k, *_ in ss.scan_text(text) if k == 3]
    assert got == ADDED[text]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts(text):
    assert [s for s in ss.scan_text(text) if s[2] == 3] == []


def test_query_rows_and_edges(spark, tmp_path):
    texts = cases.TEXTS + SHORT + list(ADDED) + CLEAN
    docs = cases.documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = ss.op11_secret_lexer(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        base, r = plain(t or "") if len(t or "") < 10_000 else [], got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, k in base) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("literal")]
        assert kept == [f"{ss.KINDS[k]}:{a}:{b}" for a, b, k in base]
        assert r["spans"] == ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, b, k, *_ in ss.scan_text(t or ""))
    assert ss.scan(cases.no_documents(spark)).count() == 0


def test_chains_and_doubled_names_end():
    chain = "x0 = 'kd83Jd92'\n" + "".join(f"x{i + 1} = x{i} + x{i}\n" for i in range(3000)) + "pwd = x3000"
    assert [chain[a:b] for a, b, k, *_ in ss.scan_text(chain) if k == 3] == ["kd83Jd92"]


def test_redact(spark):
    docs = spark.createDataFrame([(1, 'a token="abcdefgh12" b'), (2, "plain"), (3, None), (4, "x AKIAABCDEFGHIJKLM")], "doc_id bigint, text string")
    got = {r["id"]: r["text"] for r in ss.redact(docs).collect()}
    assert got == {1: 'a [secret]" b', 2: "plain", 3: None, 4: "x [secret]"}


def test_long_texts_take_linear_time():
    import time
    for unit in ("password ", 'x = "a', "'a ", "a-", "<password>", "token=" + "a" * 3, '"""', "--pwd ", "f" * 31 + " "):
        text = unit * (400_000 // len(unit))
        start = time.perf_counter()
        ss.scan_text(text)
        assert time.perf_counter() - start < 20, unit
