"""The end-to-end scan over small sources in four languages, with findings written by hand."""

import os

import pytest

from ferrule.operators import report
from ferrule.plans import extract, scan
from ferrule.sources import files, kb, sinks

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")


@pytest.fixture(scope="module")
def got(spark):
    return scan.scan(spark, HERE)


def test_findings(got):
    rows = {(os.path.basename(r.file_path), r.line, r.symbol): r for r in got["findings"].collect()}
    seen = {k: (r.profile_id, r.key_bits, r.severity, list(r.wrapper_chain)) for k, r in rows.items()}
    assert seen == {
        ("wrap.py", 9, "RSA.generate"): ("ALG.RSA.PKE", None, "high", []),
        ("wrap.py", 13, "make_key"): ("ALG.RSA.PKE", None, "high", ["RSA.generate", "make_key"]),
        ("wrap.py", 17, "make_key_bytes"): ("ALG.RSA.PKE", 1024, "high", ["RSA.generate", "make_key", "make_key_bytes"]),
        ("wrap.py", 18, "RSA.generate"): ("ALG.RSA.PKE", 1024, "high", []),
        ("wrap.py", 20, "RSA.generate"): ("ALG.RSA.PKE", 2048, "high", []),
        ("wrap.py", 22, "Block.new"): ("ALG.AES", 128, "high", []),
        ("wrap.py", 23, "hashlib.md5"): ("ALG.MD5", None, "high", []),
        ("tool.c", 6, "RSA_generate_key_ex"): ("ALG.RSA.PKE", None, "high", []),
        ("tool.c", 10, "EVP_aes_128_cbc"): ("ALG.AES", 128, "medium", []),
        ("tool.c", 11, "generate"): ("ALG.RSA.PKE", 1024, "high", ["RSA_generate_key_ex", "generate"]),
        ("Keys.java", 8, "KeyGenerator.getInstance"): ("ALG.AES", 128, "medium", []),
        ("Keys.java", 10, "Cipher.getInstance"): ("ALG.3DES", 168, "medium", []),
        ("Keys.java", 11, "Cipher.getInstance"): ("ALG.AES", None, "high", []),
        ("main.go", 10, "r.GenerateKey"): ("ALG.RSA.PKE", None, "high", []),
        ("main.go", 14, "newKey"): ("ALG.RSA.PKE", 2048, "high", ["r.GenerateKey", "newKey"]),
        ("main.go", 16, "aes.NewCipher"): ("ALG.AES", 128, "medium", []),
        ("main.go", 17, "md5.New"): ("ALG.MD5", None, "high", []),
    }


def test_status_and_summary(got):
    status = {os.path.basename(r.file_path): r.status for r in got["files"].collect()}
    assert status == {"wrap.py": "ok", "broken.py": "error", "tool.c": "ok", "sizes.h": "ok", "Keys.java": "ok", "main.go": "ok"}
    s = got["summary"].first()
    assert (s.files, s.files_ok, s.files_error, s.files_with_findings, s.findings) == (6, 5, 1, 4, 17)


def test_languages_are_pruned(spark):
    got = files.scan(spark, HERE, langs=["go"])
    assert [os.path.basename(r.file_path) for r in got.collect()] == ["main.go"]
    assert files.scan(spark, HERE, recursive=False).count() == 0


def test_includes(spark):
    got = files.includes(files.scan(spark, HERE)).collect()
    assert [(os.path.basename(r.file_path), r.include, os.path.basename(r.target)) for r in got] == [("tool.c", "sizes.h", "sizes.h")]


def test_guard_keeps_large_files_as_skipped(spark, tmp_path):
    (tmp_path / "big.py").write_bytes(b"x = 1\n" * 1_000_000)
    (tmp_path / "odd.py").write_bytes(b"x = '\xff'\n")
    got = {os.path.basename(r.file_path): r for r in files.scan(spark, str(tmp_path)).collect()}
    assert (got["big.py"].status, got["big.py"].code) == ("skipped", None)
    assert "�" in got["odd.py"].code


def test_empty_tree(spark, tmp_path):
    (tmp_path / "a.py").write_text("\n")
    got = scan.scan(spark, str(tmp_path))
    assert got["findings"].count() == 0 and got["summary"].first().files == 1


def test_sinks(spark, got, tmp_path):
    sinks.save_json(got["findings"], str(tmp_path / "json"))
    sinks.save_markdown(got["findings"], str(tmp_path / "md"))
    assert spark.read.json(str(tmp_path / "json")).count() == 17
    text = "\n".join(r.value for r in report.markdown(got["findings"]).collect())
    assert text.startswith("## High") and "wrap.py:17" in text
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [r.value for r in report.dot(edges).select("value").collect()] == ["digraph calls {", '  "a" -> "b";', '  "b" -> "c";', "}"]
    c = spark.createDataFrame([("w1", 1), ("w2", 2)], "api_id string, v int")
    sinks.save_contracts(c, str(tmp_path / "c"))
    sinks.save_contracts(spark.createDataFrame([("w2", 3)], "api_id string, v int"), str(tmp_path / "c"), merge=True)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c")).collect())) == [("w1", 1), ("w2", 3)]


def test_loaders(spark, tmp_path):
    (tmp_path / "m.json").write_text('{ // rules\n "mappings": [{"api_id": "a", "function": "lib.gen", "func_params": ["k", "bits"], "semantic": {"profile_id": "ALG.RSA", "key": {"param": "bits"}}}, {"api_id": "b", "function": "lib.gen", "semantic": {"profile_id": "ALG.X", "operation": "keygen"}}]}')
    r = kb.load_mappings(spark, str(tmp_path / "m.json"), "c").collect()
    assert [(x.symbol, x.profile_id, x.bits_arg, x.category, x.arg_kind) for x in r] == [("lib.gen", "ALG.RSA", 1, "keygen", "size")]
    params, free = kb.load_policy(spark, '{"org_policy": {"enforce_params": {"ALG.RSA": {"key_bits": {"allow": [3072], "severity_if_not_allow": "high"}}}, "transitional_whitelist": {"algorithms": ["ALG.3DES"]}}}')
    assert params.first().allow == ["3072"] and free.first().key == "ALG.3DES"
    assert kb.strip_comments('{"u": "http://x" /* c */} // d') == '{"u": "http://x" } '


def test_lexer_owner_and_args():
    rows = list(extract.file_facts("int f(int a) { return g(a, h(1, 2)); } // g(3)\n", "c"))
    calls = [(r["name"], r["owner"], r["args"]) for r in rows if r["kind"] == "call"]
    assert calls == [("g", "f", ["a", "h(1, 2)"]), ("h", "f", ["1", "2"])]
    assert [r["params"] for r in rows if r["kind"] == "function"] == [["a"]]


def test_literals_are_whole():
    from ferrule.plans import extract

    text = "k" * 900
    for lang, code in (("python", f'x = "{text}"\n'), ("java", f'class A {{ String x = "{text}"; }}')):
        assert any(f["kind"] == "literal" and text in f["value"] for f in extract.file_facts(code, lang))


def test_a_decoy_tail_is_no_finding(spark, tmp_path):
    (tmp_path / "decoy.py").write_text("import mine.RSA\nfrom other import AES\nk = mine.RSA.generate(1024)\nc = AES.new(k)\n")
    (tmp_path / "real.PY").write_text("from Crypto.PublicKey import RSA\nk = RSA.generate(1024)\n")
    found = lambda **k: sorted((os.path.basename(r.file_path), r.line) for r in scan.scan(spark, str(tmp_path), **k)["findings"].collect())
    assert found() == [("real.PY", 2)]
    assert len(found(skip=["imports"])) == 3


def test_policy_contracts_switches_and_validators(spark, tmp_path):
    (tmp_path / "a.py").write_text("import hashlib\nimport lib\nfrom Crypto.PublicKey import RSA\n\ndef make(bits):\n    return RSA.generate(bits)\n\na = RSA.generate(4096)\nb = hashlib.md5(a)\nc = lib.seal(a)\nd = make(2048)\n")
    policy = kb.load_policy(spark, '{"org_policy": {"enforce_params": {"ALG.RSA": {"key_bits": {"allow": [3072], "severity_if_not_allow": "critical"}}}, "transitional_whitelist": {"algorithms": ["ALG.MD5"]}}}')
    contracts = spark.createDataFrame([("w", "python", "lib.seal", "ALG.3DES", "manual")], "api_id string, lang string, symbol string, profile_id string, source string")
    said = []
    got = {r.line: r for r in scan.scan(spark, str(tmp_path), policy=policy, contracts=contracts, progress=lambda *x: said.append(x))["findings"].collect()}
    assert (got[8].severity, got[8].reason) == ("critical", "policy: key_bits") and got[9].severity == "low" and got[10].profile_id == "ALG.3DES" and 11 in got
    assert [x[0] for x in said] == [1, 2, 3, 4]
    lines = lambda **k: {r.line for r in scan.scan(spark, str(tmp_path), **k)["findings"].collect()}
    assert 11 not in lines(skip=["wrappers"])
    assert lines(validators=[lambda f: f["profile_id"] == "ALG.MD5"]) == {9}
    with pytest.raises(ValueError):
        lines(skip=["anything"])


def test_quick_scan_analyzers_and_readers(spark, tmp_path):
    from ferrule.plans import registry

    (tmp_path / "a.py").write_text("print(len('x'))\n")
    assert sorted(r.symbol for r in scan.quick_scan(spark, str(tmp_path)).collect()) == ["len", "print"]

    class Prints:
        name = "prints"

        def analyze(self, facts):
            return facts["calls"].where("symbol = 'print'").select("file_path", "line", "symbol")

    facts = extract.facts(extract.extract(files.scan(spark, str(tmp_path))))
    seen = []
    rows = registry.run([Prints(), Prints()], facts, lambda *x: seen.append(x)).collect()
    assert [(r.line, r.symbol, r.analyzer, r.severity) for r in rows] == [(1, "print", "prints", None)] * 2 and seen == [(1, 2, "prints"), (2, 2, "prints")]
    reader = {"python": lambda code: iter([{"kind": "error", "line": 7, "value": "own"}])}
    assert [(r.line, r.value) for r in extract.extract(files.scan(spark, str(tmp_path)), reader).select("line", "value").collect()] == [(7, "own")]
    assert set(registry.MATCHERS) == {"precise", "legacy", "suffix"}


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "big.c").write_bytes(b"x" * (files.MAX_BYTES + 1))
    (tmp_path / "small.H").write_text("int a;")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", files.MAX_BYTES)
    try:
        assert sorted((os.path.basename(r.file_path), r.status, r.code) for r in files.scan(spark, str(tmp_path)).collect()) == [("big.c", "skipped", None), ("small.H", "ok", "int a;")]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_no_wrapper_folders(spark):
    assert kb.load_wrappers(spark, None, None).count() == 0
