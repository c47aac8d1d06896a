"""Byte-level BPE encoding and decoding by DuckDB recursive queries within each partition.

Pieces (matches of the pre-tokeniser pattern) are encoded once for each distinct
piece. A recursive query holds token-position rows (pos, word, id). Each step joins
neighbouring rows with the table of pairs and contracts each word's leftmost pair of
minimum rank, and every pair that no later merge can disturb; a word without a pair
rests. The tables are made from the ranks alone: every split of a token into two tokens.
Decoding joins ids with the vocabulary and aggregates their bytes in order.

What keeps steps few and long pieces cheap, with the same ids:

- A boundary of two bytes that no token of the vocabulary has inside can't be
  crossed by a merge, so a piece is contracted in the parts between these.
- A pair is contracted early if its rank is below that of every pair which a token
  that ends in the one before it makes with its first token, or its second one with a
  token that begins with the one after it: whatever these grow to, they take neither
  of its tokens first. The token made must be in no pair of a lower rank than its own,
  so that no merge comes sooner for it than in the plain order.
- In longer words with few such pairs, further pairs of the minimum rank are
  contracted in the same step instead, up to the first whose token makes a pair of
  lower rank with a neighbour: until then the leftmost pair of minimum rank is the
  next of these anyway.
- The recursion is keyed by position: a step overwrites the rows of the step
  before, so a query holds one row for each byte of its pieces, which are taken
  `BYTES` at a time (or one piece, with memory in proportion).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from mendery.llm.common import arrow_rows, batches_of, only, read, text_batches
from mendery.llm.textvec import PieceCache, Texts

#: Bytes of pieces in one recursive query, tokens in one decoding query.
BYTES, TOKENS = 1_000_000, 500_000

_MERGES = """
CREATE TABLE merges AS
SELECT l.id AS l, r.id AS r, v.id AS id
FROM (SELECT id, hex, unnest(range(2, length(hex), 2)) AS k FROM vocab) v
JOIN vocab l ON l.hex = substr(v.hex, 1, v.k)
JOIN vocab r ON r.hex = substr(v.hex, v.k + 1)
"""

#: Of neighbouring tokens: `rank` of the pair; `lone`, the same if the token made is in no pair of a lower rank; `a`, the least
#: rank that a token which ends in `l` has with `r`; `b`, the least that `l` has with a token which begins with `r`.
_PAIRS = """
CREATE TABLE pairs AS
WITH parts AS (SELECT id, hex, unnest(range(0, length(hex), 2)) AS k FROM vocab),
ends AS (SELECT p.id, v.id AS part FROM parts p JOIN vocab v ON v.hex = substr(p.hex, p.k + 1)),
begins AS (SELECT p.id, v.id AS part FROM parts p JOIN vocab v ON v.hex = substr(p.hex, 1, p.k + 2)),
every AS (
  SELECT l, r, id AS rank, NULL AS a, NULL AS b FROM merges
  UNION ALL SELECT e.part, m.r, NULL, m.id, NULL FROM merges m JOIN ends e ON e.id = m.l
  UNION ALL SELECT m.l, e.part, NULL, NULL, m.id FROM merges m JOIN begins e ON e.id = m.r
)
SELECT l, r, coalesce(rank, 2147483647)::INT AS rank, coalesce(CASE WHEN early.id IS NULL THEN rank END, 2147483647)::INT AS lone,
  coalesce(a, 2147483647)::INT AS a, coalesce(b, 2147483647)::INT AS b
FROM (SELECT l, r, min(rank) AS rank, min(a) AS a, min(b) AS b FROM every GROUP BY l, r)
LEFT JOIN (SELECT l AS id FROM merges WHERE id < l UNION SELECT r FROM merges WHERE id < r) early ON early.id = rank
"""

#: Pairs of a lower rank than one of their tokens.
_LOWERS = "CREATE TABLE lowers AS SELECT * FROM merges WHERE id < l OR id < r"

#: A step reads the rows of the last one; `n` counts steps, so that rows which stay alike go on too. Id -1 is a row that a
#: contraction took away. `rank` is the pair's of a row and the next one, `best` the word's least and `first` where it stands
#: first. `safe` rows are contracted early, `taken` ones follow them. Words of up to 16 rows, or with one safe row in 16, are
#: `quick`: no two of their safe rows and the first are neighbours. In the others, every other pair of a run of neighbouring
#: ones of rank `best` is a site, and `lower` tells whether the token made there would make a pair of a lower rank with the
#: token before it (or the one made there) or after it; sites up to the first such one are contracted.
_ENCODE = """
WITH RECURSIVE step(pos, word, id, n) USING KEY (pos) AS (
  SELECT pos, word, id, 0 FROM bytes
  UNION
  SELECT * FROM (
    WITH live AS MATERIALIZED (
      SELECT pos, word, id, n, rank, lag(pos) OVER w AS back, lone < lag(a, 1, 2147483647) OVER w AND lone < lead(b, 1, 2147483647) OVER w AS safe,
        lag(lone, 1, 2147483647) OVER w < lag(a, 2, 2147483647) OVER w AND lag(lone, 1, 2147483647) OVER w < b AS taken
      FROM (
        SELECT t.pos, t.word, t.id, t.n, coalesce(p.rank, 2147483647) AS rank, coalesce(p.lone, 2147483647) AS lone, coalesce(p.a, 2147483647) AS a, coalesce(p.b, 2147483647) AS b
        FROM (SELECT pos, word, id, n, CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next FROM step WHERE id >= 0 WINDOW w AS (ORDER BY pos)) t
        LEFT JOIN pairs p ON p.l = t.id AND p.r = t.next
      ) WINDOW w AS (ORDER BY pos)
    ),
    words AS MATERIALIZED (
      SELECT word, best, first, rows <= 16 OR 16 * sites >= rows AS quick
      FROM (SELECT word, min(rank) AS best, (min(rank::BIGINT * 2147483648 + pos) % 2147483648)::INT AS first, count(*) AS rows, count(*) FILTER (WHERE safe) AS sites FROM live GROUP BY word)
      WHERE best < 2147483647
    )
    SELECT pos, word, CASE WHEN safe OR pos = first THEN rank WHEN taken OR back = first THEN -1 ELSE id END, n + 1 FROM live JOIN words USING (word) WHERE quick
    UNION ALL
    SELECT pos, word, CASE WHEN site THEN best WHEN lag(site, 1, false) OVER (PARTITION BY word ORDER BY pos) THEN -1 ELSE id END, n + 1
    FROM (
      SELECT pos, word, id, n, best, at_site AND coalesce(NOT bool_or(at_site AND lower) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS site
      FROM (
        SELECT s.*, (coalesce(b.id < s.best, false) OR coalesce(c.id < s.best, false)) AS lower
        FROM (
          SELECT *, CASE WHEN lag(at_site, 2, false) OVER w THEN best ELSE lag(id) OVER w END AS before, lead(id, 2) OVER w AS after
          FROM (
            SELECT *, rank = best AND (row_number() OVER (PARTITION BY word, run, rank = best ORDER BY pos)) % 2 = 1 AS at_site
            FROM (
              SELECT live.*, best, sum(CASE WHEN rank = best THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
              FROM live JOIN words USING (word) WHERE NOT quick
            )
          ) WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) s
        LEFT JOIN lowers b ON s.at_site AND b.l = s.before AND b.r = s.best
        LEFT JOIN lowers c ON s.at_site AND c.l = s.best AND c.r = s.after
      )
    )
  )
)
SELECT word, id FROM step WHERE id >= 0 ORDER BY pos
"""

_DECODE = "SELECT unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocab USING (id)"


class SqlCodec:
    """Encodes and decodes by the ranks in a file, with DuckDB on one thread and so many MB, more for a piece above `BYTES`."""

    def __init__(self, path: str, memory: int = 400):
        import base64

        import duckdb
        import pyarrow as pa

        # without a folder nothing is written beside Spark's own; queries are small enough
        self.memory = memory
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory}MB", "temp_directory": ""})
        with open(path, "rb") as f:
            ranks = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self._table("v", pa.table({"hex": [t.hex().upper() for t, _ in ranks], "id": pa.array([i for _, i in ranks], pa.int32())}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        for made in (_MERGES, _PAIRS, _LOWERS):
            self.con.execute(made)
        self.byte = np.zeros(256, np.int32)
        self.within = np.zeros((256, 256), bool)  # neighbouring bytes that some token has
        for t, i in ranks:
            if len(t) == 1:
                self.byte[t[0]] = i
            x = np.frombuffer(t, np.uint8)
            self.within[x[:-1], x[1:]] = True
        self.cache = PieceCache(self.encode_words, most=6_000_000)

    def _table(self, name: str, table) -> None:
        self.con.register(name, table)

    def encode_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and their numbers."""
        out = [self._contracted([x[0] for x in held]) for held in batches_of(((p.encode("utf-8", "replace"),) for p in pieces), BYTES)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _contracted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        n = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.cumsum(n) - n
        new = np.zeros(len(flat), bool)
        new[starts[n > 0]] = True
        new[1:] |= ~self.within[flat[:-1], flat[1:]]
        part = np.cumsum(new) - 1
        self._table("bytes", pa.table({"word": part.astype(np.int32), "pos": np.arange(len(flat), dtype=np.int32), "id": self.byte[flat]}))
        if len(flat) > BYTES:
            self.con.execute(f"SET memory_limit = '{self.memory * len(flat) // BYTES}MB'")
        out = self.con.sql(_ENCODE).to_arrow_table()
        if len(flat) > BYTES:
            self.con.execute(f"SET memory_limit = '{self.memory}MB'")
        of = np.repeat(np.arange(len(raw)), n)[np.flatnonzero(new)]  # part -> piece
        return out.column("id").to_numpy(), np.bincount(of[out.column("word").to_numpy()], minlength=len(raw)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = Texts(texts)
        begin, end, of = t.matches()
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        rows = self.cache.rows(t, begin, end)
        return self.cache.gather(rows), np.bincount(of, self.cache.count[rows], len(texts)).astype(np.int64)

    def _bytes(self, ids: np.ndarray):
        """The bytes of a sequence of ids, some tokens at a time."""
        import pyarrow as pa

        for a in range(0, len(ids), TOKENS):
            some = ids[a : a + TOKENS]
            self._table("tokens", pa.table({"pos": np.arange(len(some), dtype=np.int32), "id": some}))
            yield self.con.sql(_DECODE).fetchall()[0][0]

    def decoded(self, ids: np.ndarray, counts: np.ndarray):
        """For each of several sequences of ids, one after another, its bytes in some pieces."""
        upto = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        cuts = upto[np.cumsum(counts)].tolist()
        source, rest, at = self._bytes(ids), b"", 0
        for end in cuts:
            pieces = []
            while at < end:
                rest = rest or next(source)
                pieces.append(rest[: end - at])
                rest = rest[len(pieces[-1]) :]
                at += len(pieces[-1])
            yield pieces

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each sequence of ids."""
        return [b"".join(x) for x in self.decoded(ids, counts)]

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        rows = self.con.sql("SELECT id, length(hex) // 2 AS n FROM vocab").fetchnumpy()
        out = np.zeros(int(rows["id"].max()) + 1, np.int64)
        out[rows["id"]] = rows["n"]
        return out


def codec(path: str) -> SqlCodec:
    """The worker's codec for a file; its tasks follow one another."""
    return only(("codec", path), lambda: SqlCodec(path))


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(df: DataFrame, path: str, chars: int = 1_000_000) -> DataFrame:
    """Every whole text to ids and back: doc_id, n_tokens and the digests of ids and of decoded bytes.

    Null texts are empty (no ids); repeated rows give rows like others; an empty
    table gives none. Other columns play no part. Distinct pieces are kept in a
    bounded cache over the texts of a worker; a batch has at most `chars`
    characters, or one text.
    """

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for held in batches_of(arrow_rows(batches, "doc_id", "text"), chars):
            ids, counts = own.encode([x[1] for x in held])
            decoded = [hashlib.sha256(b"".join(x)).hexdigest() for x in own.decoded(ids, counts)]
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            shas = [hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends, counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return text_batches(df).select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op9_sql_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
