import base64
import json
import re

from modlens.llm import secret_scan as S
from modlens.llm.queries import QUERIES


def tlv(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | (k := (n.bit_length() + 7) // 8)]) + n.to_bytes(k, "big")
    return bytes([tag]) + head + body


INT = lambda n: tlv(2, n)
PKCS1 = tlv(0x30, INT(b"\0") + b"".join(INT(bytes([i]) * 20) for i in range(1, 9)))
PKCS8 = tlv(0x30, INT(b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(4, PKCS1))
SEC1 = tlv(0x30, INT(b"\1") + tlv(4, b"k" * 32) + tlv(0xA0, tlv(6, b"\x2a\x86")))
ENCRYPTED = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01050d")) + tlv(0x30, INT(b"\1" * 8))) + tlv(4, b"c" * 64))
DIGEST = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(5, b"")) + tlv(4, b"d" * 32))
CERTIFICATE = tlv(0x30, tlv(0x30, INT(b"\1") + b"i" * 60) + tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01010b"))) + tlv(3, b"s" * 64))
SSH = b"openssh-key-v1\0" + b"".join(
    len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(
    len(x).to_bytes(4, "big") + x for x in (b"public" * 5, b"private" * 9))


def b64(x, url=False):
    return (base64.urlsafe_b64encode(x).rstrip(b"=") if url else base64.b64encode(x)).decode()


def kinds(text):
    return [(k, text[s:e]) for s, _, e, k in S.find_secrets(text)]


def test_confirmed_structures():
    jwt = ".".join(b64(json.dumps(x).encode(), True) for x in ({"alg": "HS256"}, {"sub": "1"})) + ".c2ln"
    assert kinds(f"see {jwt} here") == [("token", jwt)]
    for data in (PKCS1, PKCS8, ENCRYPTED, SEC1, SSH):
        assert kinds(f"x {b64(data)} y") == [("key", b64(data))]
        assert ("key", data.hex().upper()) in kinds(f"x {data.hex().upper()} y")
        wrapped = re.sub("(.{30})", r"\1\n", b64(data))
        pem = f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}\n-----END RSA PRIVATE KEY-----"
        assert kinds(f"é {pem} z")[0] == ("key", pem)


def test_unconfirmed_structures_are_not_reported():
    for data in (DIGEST, CERTIFICATE, PKCS1[:-1], PKCS8 + b"x", SSH[:40], b"plain text that is long enough to be decoded" * 2):
        assert not kinds(f"x {b64(data)} y")
    bad = ".".join(b64(json.dumps(x).encode(), True) for x in ({"typ": "JWT"}, {"sub": "1"})) + ".c2ln"
    assert not kinds(bad)
    assert not S.signed_token("eyJ" + "W" * 50, "e30")


def test_base_patterns():
    t = 'é password = "abcd1234" TOKEN:short api-key api_key=ABCDEFGH== AKIA' + "A" * 12 + " AKIA123 " + "0f" * 16 + " " + "0f" * 15
    assert kinds(t) == [
        ("assign", 'password = "abcd1234'), ("assign", "api_key=ABCDEFGH=="), ("access", "AKIA" + "A" * 12), ("hex", "0f" * 16)]
    assert kinds("passwordKey toKen=12345678") == [("assign", "toKen=12345678")]


def brute(text):
    """The contract's base rules, by the plain patterns over the whole text."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m[2]) >= 8)
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort(key=lambda x: (x[1], S.KINDS.index(x[0])))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_query_matches_brute_force(spark):
    import hashlib

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op10_confirmed_secrets"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert r.n_assign + r.n_access + r.n_hex == len(list(filter(None, want.split(","))))
    assert any(r.n_hex for r in rows)


def test_redaction_and_edges(spark):
    rows = [(1, "a token=12345678 b"), (1, None), (None, ""), (2, "x" * 100_000 + " secret: aaaaaaaa " + "0a" * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as spans", "1 as n_hex")
    got = S.scan_secrets(d).collect()
    assert len(got) == 4
    twice = S.scan_secrets(d.unionAll(d)).collect()                       # repeated rows are scanned each for itself
    assert sorted(map(str, twice)) == sorted(map(str, got + got))
    assert [r.redacted for r in got if r.spans] == ["a [assign] b", "x" * 100_000 + " [assign] [hex]"]
    assert S.scan_secrets(d.limit(0)).collect() == []
