import struct
import uuid

from pyspark.sql import functions as F

from triagelake.plans import sinks
from triagelake.sources import bytecode as B
from triagelake.sources import containers as C
from triagelake.sources import files
from triagelake.streaming import watch


def compiled(code: bytes, resources: bytes, key: bytes = b"") -> bytes:
    def stream(data):
        if not key:
            return str(len(data)).encode() + b" 0 $" + data + b"$"
        return str(len(data)).encode() + b" 0 $" + C.decrypt(data, key) + bytes([len(key)]) + key + b"$"

    return b"\r\n FAS4-FILE ; test\r\n" + stream(code) + b"\r\n" + stream(resources)


CODE = bytes([1, 0, 0, 0, 0x14, 2, 1, 1, 0, 0x18, 3, 0, 0x09, 1, 0, 0x06, 0, 0, 0x0D, 2, 0, 0x20, 0x20, 0x35, 1, 0, 0, 0, 0x16])


def test_streams_round_trip_with_and_without_key():
    res = b"\0\0\0\0setq\0acad.lsp\0[S::STARTUP][vlr-x\0A_B\0"
    for key in (b"", b"k3y", b"z"):
        code, out, wrong = C.compiled_streams(compiled(CODE, res, key))
        assert (code, out, wrong) == (CODE, res, None)
    assert C.resource_entries(res) == [(0, "symbol", "setq"), (1, "symbol", "acad.lsp"), (2, "string", "[S::STARTUP]"), (3, "string", "[vlr-x"), (4, "string", "A_B")]
    assert C.compiled_streams(b"FAS4-FILE")[2] == "no header end" and C.compiled_streams(b"x")[2] == "no marker"
    assert C.compiled_streams(b"FAS4-FILE ; x\r\n99 0 $abc")[2] == "bad code stream"


def test_compiled_files(spark):
    df = spark.createDataFrame([("a", bytearray(compiled(CODE, b"\0\0\0\0one\0"))), ("b", bytearray(b"FAS4-FILE")), ("c", None)], "sample_id string, content binary")
    got = {r.sample_id: r for r in C.compiled_files(df).collect()}
    assert set(got) == {"a", "b"} and not got["a"].used_fallback and got["b"].used_fallback
    assert got["a"].resources[0].value == "one"


def test_container_records(spark):
    def record(name, code, blob):
        return struct.pack("<IHB", 7 + len(name) + len(blob), code, len(name)) + name + blob

    body = record(b"main", 0x0532, compiled(CODE, b"\0\0\0\0one\0")) + b"\xff" + record(b"again", 0x0532, compiled(CODE, b"\0\0\0\0one\0")) + record(b"box", 0x0546, b"dlg")
    data = b"LOAD(x)\0" + body + b"VRTLIB-1"
    df = spark.createDataFrame([("v", bytearray(data))], "sample_id string, content binary")
    got = C.containers(df).orderBy("idx").collect()
    assert [(r.name, r.kind) for r in got] == [("main", "fas"), ("again", "fas"), ("box", "dcl")]
    assert C.compiled_records(C.containers(df)).count() == 2
    assert C.container_records(b"LOAD(") == ([], ["no directory"])


def code_frame(spark):
    schema = "sample_id string, code binary, symbols array<string>, strings array<string>"
    return spark.createDataFrame([("s", bytearray(CODE), ["foo", "bar"], ["x", "acad.lsp"]), ("n", None, None, None), ("short", bytearray(b"\0\0"), [], [])], schema)


def test_instructions_and_frames(spark):
    i = B.instructions(code_frame(spark))
    names = [r.name for r in i.where("sample_id = 's'").orderBy("seq").collect()]
    assert names == ["DEFUN", "INIT_ARGS", "PUSH_CONST", "SETQ_GVAR", "BR_IF_FALSE", "NOP", "NOP", "CALL", "END_DEFUN"]
    f = B.frames(i).first()
    assert (f.num_args, f.frame_size, f.locals, f.calls) == (1, 3, 2, ["foo"])
    assert {(r.kind, r.dst) for r in B.edges(i).collect()} == {("BR_IF_FALSE", 23), ("fallthrough", 21)}
    assert B.block_starts(i).count() == 3
    b = B.bindings(i).first()
    assert (b.scope, b.value, b.symbol) == (-1, "acad.lsp", "foo")
    assert B.owners(i, B.frames(i)).where("owner is null").count() == 0


def test_unknown_codes_take_one_byte():
    assert [x[1] for x in B.disassemble(b"\0\0\0\0\xfe\x01")] == ["UNKNOWN_FE", "PUSH_NIL"]
    assert B.disassemble(b"\0\0\0\0\x33\x01") == []


def test_indicators_become_effects(spark):
    rows = [("s", 0, "http://a.example/x"), ("s", 1, "WScript.Shell"), ("s", 2, r"HKEY_CURRENT_USER\x"), ("s", 3, "cmd.exe /c"), ("s", 4, "HTTP://a.example/x"), ("s", 5, "plain")]
    e = B.summary_effects(B.resource_summary(spark.createDataFrame(rows, "sample_id string, idx int, value string")))
    kinds = sorted(r.effect_type for r in e.collect())
    assert kinds == ["com_create", "file_write", "network_connect", "process_create", "registry_modify"]


def test_scan_and_manifests(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.LSP").write_text("(defun a ())")
    (root / "sub" / "b.lsp").write_text("Sub A()\nDim x As Long\nEnd Sub\n")
    (root / "sub" / "c.fas").write_bytes(compiled(CODE, b"\0\0\0\0one\0"))
    (root / "d.txt").write_text("no")
    got = {r.sample_id: r.input_type for r in files.scan(spark, str(root)).collect()}
    assert got == {"a.LSP": "lsp", "b.lsp": "lsp-vba", "c.fas": "fas"}
    m = tmp_path / "m.csv"
    m.write_text("id,Sample\n1, b \n2,a\n3,b\n4,\n")
    assert [r[0] for r in files.csv_manifest(spark, str(m)).collect()] == ["a", "b"]
    t = tmp_path / "m.txt"
    t.write_text("\ufeffsample\n\"x\"\ny\n\nx\n")
    assert [r[0] for r in files.line_manifest(spark, str(t)).collect()] == ["x", "y"]
    assert files.manifest(spark, str(tmp_path / "none.csv"), str(m), None).count() == 2
    assert files.manifest(spark, None, None, str(root)).count() == 3


def test_metadata_and_relocation(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.txt").write_text('{"md5": "AB", "sha256": "CD", "label": "x", "names": ["n"]}')
    (tmp_path / "j" / "b.txt").write_text("broken")
    got = {(r.kind, r.key) for r in files.metadata(spark, str(tmp_path / "j")).collect()}
    assert got == {("md5", "ab"), ("sha256", "cd")}
    gone = spark.createDataFrame([("old/x/a.lsp",)], "path string")
    have = spark.createDataFrame([("new/y/a.lsp",), ("new/x/a.lsp",), ("new/x/b.lsp",)], "path string")
    assert files.relocate(gone, have).first().found == "new/x/a.lsp"
    assert files.defaults({"a": {"x": 1}}, {"a": {"x": 0, "y": 2}, "b": 3}) == {"a": {"x": 1, "y": 2}, "b": 3}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345), (2, None)], "id int, risk double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(r.risk for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["0.0000", "0.1235"]
    lines = spark.createDataFrame([("v", 0, ";; record a"), ("v", 1, "x"), ("v", 2, ";; record b"), ("v", 3, "y")], "sample_id string, pos int, line string")
    assert {r.module: r.source for r in sinks.modules(lines).collect()} == {1: ";; record a\nx", 2: ";; record b\ny"}


def test_folder_watch(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.lsp").write_text('(load "acad.lsp")')
    got = []

    def keep(batch, _):
        got.extend(r.sample_id for r in watch.arriving_facts(batch).where("fact = 'effect'").collect())

    watch.each_batch(watch.arriving_files(spark, str(root)), keep, uuid.uuid4().hex).awaitTermination()
    assert got == ["a.lsp"]
