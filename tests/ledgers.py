"""Small ledgers typed in by hand or drawn at random."""

import random

TX = "id bigint, hash string, block_id bigint"
TX_IN = "id bigint, tx_in_id bigint, tx_out_id bigint, tx_out_index int, redeemer_id bigint"
TX_OUT = (
    "id bigint, tx_id bigint, idx int, address string, address_raw string, "
    "stake_address_id bigint, value bigint"
)


class Book:
    """Writes transactions: pay(tx, outputs, spends)."""

    def __init__(self):
        self.tx, self.tx_in, self.tx_out = [], [], []

    def pay(self, tx_id, outputs, spends=(), block=None):
        """``outputs`` are (address, value[, stake]); ``spends`` are (tx_id, index)."""
        self.tx.append((tx_id, f"h{tx_id}", tx_id if block is None else block))
        for idx, (address, value, *stake) in enumerate(outputs):
            self.tx_out.append(
                (tx_id * 100 + idx, tx_id, idx, address, f"raw-{address}", stake[0] if stake else None, value)
            )
        for made_by, idx in spends:
            self.tx_in.append((made_by * 100 + idx, tx_id, made_by, idx, None))
        return self

    def tables(self, spark):
        return (
            spark.createDataFrame(self.tx, TX),
            spark.createDataFrame(self.tx_in, TX_IN),
            spark.createDataFrame(self.tx_out, TX_OUT),
        )


def random_book(seed, transactions=60, addresses=40):
    rng = random.Random(seed)
    book, unspent = Book(), []
    for tx_id in range(1, transactions + 1):
        rng.shuffle(unspent)
        take = rng.choice([0, 1, 1, 2, 3]) if unspent else 0
        spends, unspent = unspent[:take], unspent[take:]
        outputs = [
            (f"a{rng.randrange(addresses):03d}", rng.randrange(1, 100), rng.randrange(0, 6))
            for _ in range(rng.choice([1, 2, 2, 2, 3]))
        ]
        book.pay(tx_id, outputs, spends, block=tx_id // 4)
        unspent += [(tx_id, i) for i in range(len(outputs))]
    return book


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def union_find(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
