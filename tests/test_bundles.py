import hashlib
import json

from lectern.sources import bundles


def _command(n, **change):
    return {
        "command_id": f"c{n}", "device_id": "d", "sequence": n, "occurred_at": f"2024-01-0{n}T00:00:00Z",
        "paper_id": "p", "action": "set_read", "value": True, **change,
    }


def _bundle(commands, digest=None, **change):
    payload = {"schema_version": "1", "bundle_id": "b é  ", "generated_at": "2024-02-01T00:00:00Z", "commands": commands, **change}
    payload = {k: v for k, v in payload.items() if v is not None}
    canonical = json.dumps(payload, ensure_ascii=True, separators=(",", ":"), sort_keys=True)
    return {**payload, "digest": digest or hashlib.sha256(canonical.encode()).hexdigest()}


CASES = {
    "accepted": json.dumps(_bundle([_command(1), _command(2)])),
    "accepted_as_written": json.dumps(_bundle([_command(1), _command(2)]), indent=3, ensure_ascii=False),
    "accepted_empty": json.dumps(_bundle([])),
    "digest_mismatch": json.dumps(_bundle([_command(1)], digest="0" * 64)),
    "digest_mismatch_by_edit": json.dumps({**_bundle([_command(1)]), "bundle_id": "other"}),
    "digest_mismatch_by_extra": json.dumps({**_bundle([_command(1)]), "note": [1.5, None]}),
    "unreadable_cut": json.dumps(_bundle([_command(1)]))[:-9],
    "unreadable_list": "[1]",
    "unreadable_blank": " ",
    "unreadable_twice": '{"digest":"a",' + json.dumps(_bundle([]))[1:],
    "incomplete": json.dumps(_bundle([_command(1)], bundle_id=None)),
    "incomplete_command": json.dumps(_bundle([_command(1, value=None)])),
    "incomplete_type": json.dumps(_bundle([_command(1, sequence="first")])),
    "too_many_commands": json.dumps(_bundle([_command(n) for n in (1, 2, 3, 4)])),
    "not_ordered": json.dumps(_bundle([_command(2), _command(1)])),
    "repeated_command": json.dumps(_bundle([_command(1), _command(1)])),
    "too_large": json.dumps(_bundle([_command(1)], bundle_id="x" * 5000)),
}


def test_every_status(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    (tmp_path / "unreadable_bytes.json").write_bytes(b"{\xff}")
    (tmp_path / "other.txt").write_text("no bundle")
    rows = bundles.read_bundles(spark, str(tmp_path), "*.json", 4000, 3).collect()
    found = {r.path.rsplit("/", 1)[1][:-5]: r for r in rows}
    assert set(found) == {*CASES, "unreadable_bytes"}
    assert {n: r.status for n, r in found.items() if not n.startswith(r.status)} == {}
    assert {n for n, r in found.items() if r.bundle is not None} == {n for n in CASES if n.startswith("accepted")}
    assert len(found["accepted"].bundle.commands) == 2


def test_no_files(spark, tmp_path):
    assert bundles.read_bundles(spark, str(tmp_path), "*.json", 4000, 3).count() == 0
