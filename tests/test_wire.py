"""Binary envelopes: what the wire format allows, and what must fail."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.plans.encode import message_bytes, varint
from tickloom.sources import messages as M
from tickloom.sources import wire

KIND = wire.envelope_message()
TRADE = {
    "schema_version": 1, "event_id": "solana:pumpfun:trade:sig:inner:3:7", "chain": 1, "protocol": 1, "event_type": 1, "commitment": 1, "slot": 42,
    "tx_signature": "sig", "tx_index": 2, "instruction_path": {"source": 2, "outer_index": 3, "inner_index": 7}, "event_source": 1, "event_unix_ts": 1_700_000_000,
    "refs": {"mint": "m", "bonding_curve": "c", "user": "é🙂"},
    "pumpfun_trade": {"side": "buy", "mint": "m", "sol_amount": "100", "track_volume": True, "instruction_args": {"amount": "1000", "max_sol_cost": ""}},
}


def plain(bytes_, kind=KIND):
    """One message, read field by field."""

    def number(at):
        value = shift = 0
        while True:
            if at >= len(bytes_) or shift > 63:
                raise ValueError("cut")
            value |= (bytes_[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if bytes_[at - 1] < 128:
                return value & (2**64 - 1), at

    def read(at, end, kind, out):
        known = {f.number: f for f in kind.fields}
        while at < end:
            tag, at = number(at)
            n, t = tag >> 3, tag & 7
            if t == 0:
                value, at = number(at)
            elif t == 2:
                size, at = number(at)
                value, at = (at, at + size), at + size
            elif t in (1, 5):
                at += 8 if t == 1 else 4
            else:
                raise ValueError("tag")
            if at > end or not 0 < n < 1 << 29:
                raise ValueError("cut")
            f = known.get(n)
            if f is None or t != M.wire_type(f):
                continue
            if f.message is not None:
                if f.alternative:
                    for g in kind.fields:
                        if g.alternative and g.name != f.name:
                            out[g.name] = None
                read(*value, f.message, out.setdefault(f.name, None) or out.update({f.name: {}}) or out[f.name])
            elif t == 2:
                out[f.name] = bytes_[value[0] : value[1]].decode()
            else:
                kind_ = f.kind.typeName()
                out[f.name] = bool(value) if kind_ == "boolean" else ((value & 0xFFFFFFFF) ^ 2**31) - 2**31 if kind_ == "integer" else (value ^ 2**63) - 2**63
        return out

    def filled(out, kind):
        default = {"string": "", "boolean": False}
        return {
            f.name: (filled(out[f.name], f.message) if out.get(f.name) is not None else None) if f.message is not None else out.get(f.name, None if f.tracked else default.get(f.kind.typeName(), 0))
            for f in kind.fields
        }

    try:
        return filled(read(0, len(bytes_), kind, {}), kind)
    except (ValueError, UnicodeDecodeError):
        return None


def decoded(rows):
    found, bad = M.decode(pa.array(rows, pa.binary()), KIND)
    return [None if b else x for x, b in zip(found.to_pylist(), bad.tolist())]


def field(n, body):
    return varint(n << 3 | 2) + varint(len(body)) + body


def test_fields():
    whole = message_bytes(TRADE, KIND)
    rows = [whole, b"", whole + varint(7 << 3) + varint(2**64 - 5), varint(12 << 3) + varint(-3), varint(3 << 3) + varint(-1)]
    rows += [varint(99 << 3 | 1) + b"12345678" + whole + varint(98 << 3 | 5) + b"1234" + field(97, b"xyz") + varint(96 << 3) + varint(2**63)]  # unknown fields
    rows += [field(1, b"text in a number") + varint(2 << 3) + varint(5)]  # other wire types than the fields'
    rows += [whole + field(2, b"later") + field(13, message_bytes({"pool": "p", "user": "u"}, KIND.fields[12].message))]  # last one counts, messages merge
    rows += [whole + field(23, b"") + field(20, field(1, b"sell")), whole + field(22, field(1, b"other"))]  # alternatives
    got = decoded(rows)
    assert got == [plain(r) for r in rows]
    assert got[0]["refs"]["user"] == "é🙂" and got[0]["refs"]["pool"] is None and got[0]["pumpfun_trade"]["fee"] == "" and got[0]["pumpfun_trade"]["instruction_args"]["max_sol_cost"] == ""
    assert got[1]["instruction_path"] is None and got[1]["event_id"] == "" and got[2]["slot"] == -5 and got[3]["event_unix_ts"] == -3
    assert got[7]["refs"] == dict(got[0]["refs"], pool="p", user="u") and got[7]["event_id"] == "later"
    assert got[8]["pumpfun_trade"]["side"] == "sell" and got[8]["pumpfun_trade"]["mint"] == "" and got[8]["pumpamm_swap"] is None
    assert got[9]["pumpfun_trade"] is None and got[9]["pumpfun_migrate"]["mint"] == "other"


def test_malformed():
    whole = message_bytes(TRADE, KIND)
    rows = [b"\xff" * 11, varint(2 << 3 | 3), varint(0 << 3 | 2) + b"\0", field(2, b"\xc3"), field(13, field(1, b"ok")[:-1]), varint(2 << 3 | 2) + varint(2**63) + b"x", varint(1 << 3), whole[:-1]]
    assert decoded(rows + [whole]) == [None] * len(rows) + [plain(whole)]
    # what is cut anywhere is either a sound shorter message or none
    rows = [whole[:n] for n in range(len(whole))]
    assert decoded(rows) == [plain(r) for r in rows]


def test_random_bytes():
    rng = random.Random(3)
    whole = message_bytes(TRADE, KIND)
    rows = []
    for _ in range(3000):
        r = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            r[rng.randrange(len(r))] = rng.randrange(256)
        rows.append(bytes(r))
    assert decoded(rows) == [plain(r) for r in rows]


def test_slices():
    whole = message_bytes(TRADE, KIND)
    array = pa.array([b"no", whole, None, whole + field(2, b"x")], pa.binary()).slice(1)
    found, bad = M.decode(array, KIND)
    assert not bad.any() and found.to_pylist() == [plain(whole), None, plain(whole + field(2, b"x"))]


def test_envelopes(spark):
    rows = [(0, dict(TRADE)), (1, dict(TRADE, commitment=9, event_source=-2)), (2, {k: v for k, v in TRADE.items() if k != "instruction_path"}), (3, {k: v for k, v in TRADE.items() if k != "pumpfun_trade"})]
    sent = [(i, bytearray(message_bytes(v, KIND))) for i, v in rows] + [(4, bytearray(b"\x0a")), (5, None)]
    found = {r.log_id: r for r in wire.read_proto_events(spark.createDataFrame(sent, "log_id long, value binary")).collect()}
    assert [found[i].error for i in range(6)] == [None, None, "instruction path missing", "unsupported payload", "malformed message", "message missing"]
    assert (found[0].commitment, found[1].commitment, found[1].event_source, found[4].event_id, found[4].chain) == ("processed", "", "", None, None)
    assert (found[0].instruction_path.source, found[0].instruction_path.inner_index, found[0].refs.user) == ("inner", 7, "é🙂")
    payload = spark.createDataFrame([(found[0].payload,)], "p string").select(F.get_json_object("p", "$.instruction_args.amount"), F.get_json_object("p", "$.fee"), F.get_json_object("p", "$.track_volume")).first()
    assert tuple(payload) == ("1000", "", "true")


def test_none(spark):
    assert wire.read_proto_events(spark.createDataFrame([], "value binary, log_id long")).count() == 0


@pytest.mark.parametrize("number", [0, 1, 127, 128, 300, 2**32, 2**64 - 1, -1])
def test_varints(number):
    assert decoded([varint(7 << 3) + varint(number)])[0]["slot"] == ((number & (2**64 - 1)) ^ 2**63) - 2**63
