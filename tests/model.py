"""A store in plain Python, step by step: staged keys in order, queued deactivations, fillers, compaction."""

from stratalog.functions.keys import END_GUARD, SHARDS, START_GUARD

FILLER = b"dummy"


class Model:
    def __init__(self, base=2048, min_kept=10, compact_at=10**9, ratio=2):
        self.next_sn = [base] * SHARDS
        self.oldest = [0] * SHARDS
        self.pending = [[] for _ in range(SHARDS)]
        self.live, self.log = {}, []
        self.min_kept, self.compact_at, self.ratio = min_kept, compact_at, ratio
        for key, shard in ((START_GUARD, 0), (END_GUARD, SHARDS - 1)):
            self.append(-1, shard, key, b"", END_GUARD, -1, -1)

    def append(self, block, shard, key, value, nxt, height, last):
        sn = self.next_sn[shard]
        self.next_sn[shard] += 1
        self.log.append((block, shard, sn, key, value, nxt, height, last, self.pending[shard]))
        self.pending[shard] = []
        if key != FILLER:
            self.live[key] = (value, nxt, height, last, sn)

    def filler(self, block, shard):
        self.pending[shard].append(self.next_sn[shard])
        self.append(block, shard, FILLER, FILLER, FILLER, -2, -2)

    def off(self, block, shard, sn):
        self.pending[shard].append(sn)
        if len(self.pending[shard]) > 64:
            self.filler(block, shard)

    def commit(self, block, ops):
        """``ops``: key to value, None deletes."""
        before = dict(self.live)
        keys = sorted((set(before) | {k for k, v in ops.items() if v is not None}) - {k for k, v in ops.items() if v is None})
        after = dict(zip(keys, [*keys[1:], keys[-1]], strict=True))
        for key in sorted(set(before) | set(after)):
            shard = key[7] // 32
            if key not in after:
                self.off(block, shard, before[key][4])
                del self.live[key]
            elif key in ops or before[key][1] != after[key]:
                if key in before:
                    self.off(block, shard, before[key][4])
                value = ops[key] if key in ops else before[key][0]
                self.append(block, shard, key, value, after[key], block, before[key][2] if key in before else 0)
        kept = sum(n - 2048 * t for n, t in zip(self.next_sn, self.oldest, strict=True))
        if len(self.live) >= self.compact_at and kept >= len(self.live) * self.ratio:
            for shard in range(SHARDS):
                if self.oldest[shard] + self.min_kept > self.next_sn[shard] >> 11:
                    continue
                held = sorted((r[4], k, r) for k, r in self.live.items() if k[7] // 32 == shard and r[4] >> 11 == self.oldest[shard])
                for sn, key, (value, nxt, height, last, _) in held:
                    self.off(block, shard, sn)
                    self.append(block, shard, key, value, nxt, height, last)
                self.oldest[shard] += 1
        for shard in range(SHARDS):
            if self.pending[shard]:
                self.filler(block, shard)
