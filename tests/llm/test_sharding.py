"""Sharding by bytes against a plain loop."""

import zlib

import pytest

from lodestar.llm.sharding import shard_by_bytes


def plain(rows, n):
    rows = sorted(((i is not None, i if i is not None else 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in rows)
    total, at, out, slots = sum(r[2] for r in rows), 0, [], {}
    for key, crc, size in rows:
        shard = min(n - 1, (2 * at + size) * n // (2 * total))
        out.append((key[1] if key[0] else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("n", (1, 4, 16))
def test_equals_a_plain_loop(make_docs, n):
    rows = [(i * 7 % 400, "x" * (i * i % 900)) for i in range(400)] + [(None, "no id"), (500, None), (3, "")]
    got = shard_by_bytes(make_docs(rows), n).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, n), key=key)


def test_sizes_are_near_equal_and_slots_gapless(make_docs):
    rows = [(i, "y" * (i * 31 % 257)) for i in range(2000)]
    got = shard_by_bytes(make_docs(rows), 16).collect()
    size, slots = {}, {}
    for r in got:
        size[r.shard] = size.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(size.values()) - min(size.values()) <= 2 * 258
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table_and_odd_texts(make_docs, odd_texts):
    assert shard_by_bytes(make_docs([]), 16).count() == 0
    assert shard_by_bytes(make_docs(odd_texts, extra=True), 16).count() == len(odd_texts)


def test_plan_is_native(make_docs):
    plan = shard_by_bytes(make_docs(["a", "b"]), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
