"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed from left to right into the longest
phrases that occur in that text; the language that needs the fewest phrases, normalised by the size of its own text,
wins. Letters only are used, in lower case; everything else is one space.

Training: at most SAMPLE_DOCS documents of a language (those with the smallest MD5 of their id, of the shorter ones), and of
these as many whole texts as fit TRAIN_CHARS letters, looked for among the first 4 * TRAIN_CHARS characters. A language that has no letters in these, as where all its texts are
longer than LONGEST, is learned from its shortest texts with letters, of the first of them at most TRAIN_CHARS letters. That bound is what the driver and each worker hold; all languages
get the same amount where they have it. More than LANGUAGES languages are refused.

Prediction reads every text to its end, and phrases are those of parsing it from left to right. Blocks of BLOCK characters
are parsed side by side, as if each began a phrase. Then each block is parsed once more with the phrase that comes in from
the block before it, until a phrase begins where one began before: from there on the parses are the same. Blocks that come
to their end before that hand on another phrase than was thought, and the next block is mended in turn.

Defined results: `und` with score 0 for texts that are null or have no letter, and for all if nothing was learned; equal
phrase counts go to the language with more labelled documents, then by name; letters that no training text has cost one
phrase each; rows with a null id are not learned from and are not held out; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedelta.llm.common import bounded_batches, held_by_worker, releasing, without

SAMPLE_DOCS, TRAIN_CHARS, LONGEST, LANGUAGES = 300, 40_000, 20_000, 500
BLOCK = 512
#: Bits a letter, and bits for the text as a whole, beyond which no learned language explains a text (the pipeline rejects it).
#: Held-out documents of sf0.1 have 2.9 bits a letter in the median, 5.1 at the 99.9th percentile and 6.7 at most (48 letters);
#: Italian, Finnish, Polish and Turkish, none of them learned, have 7.4 to 8.9 there.
FOREIGN_BITS, FOREIGN_START = 7.0, 100.0
UND = "und"


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def letters(text: str) -> str:
    """Lower-case letters, everything between them one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Model:
    """Dense transition tables, one for each language, over a common alphabet."""

    def __init__(self, samples: dict[str, str], frequency: dict[str, int]):
        import numpy as np

        # Ties go to the earlier language.
        self.langs = sorted(samples, key=lambda k: (-frequency.get(k, 0), k))
        seen = sorted({c for s in samples.values() for c in s})
        #: 0 is any letter without a code of its own; 1 is the space
        self.code = {" ": 1} | {c: i for i, c in enumerate((c for c in seen if c != " "), 2)}
        self.tables = [_automaton([self.code[c] for c in samples[k]], len(self.code) + 1) for k in self.langs]
        self.bits = np.array([np.log2(max(2, len(samples[k]))) for k in self.langs])


def _automaton(text: list[int], width: int):
    """Suffix automaton of a text as a table state x character -> state; 0 is both the start and "none"."""
    import numpy as np

    nxt, link, size, last = [{}], [-1], [0], 0
    for c in text:
        new = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
        last = new
    # Small numbers keep more of the table in the processor's caches.
    table = np.zeros((len(nxt), width), np.uint16 if len(nxt) < 1 << 16 else np.int32)
    for s, row in enumerate(nxt):
        for c, t in row.items():
            table[s, c] = t
    return table


class Parser:
    """Phrase counts of many texts at once."""

    def __init__(self, model: Model):
        import numpy as np

        self.np, self.model = np, model
        space = 1
        self.lut = np.full(sys.maxunicode + 1, space, np.uint8 if len(model.code) < 255 else np.int32)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                self.lut[c] = model.code.get(chr(c), 0)

    def counts(self, texts: list[str | None]):
        """phrases (texts x languages) and letters of each text."""
        np = self.np
        low = [t.lower() if t else "" for t in texts]
        points = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in low])
        codes = self.lut[points]
        owner = np.repeat(np.arange(len(texts)), sizes)
        # A space stays only between letters of one text.
        keep = codes != 1
        keep[1:] |= (codes[1:] == 1) & (codes[:-1] != 1)
        keep[np.cumsum(sizes) - 1] = False
        codes, owner = codes[keep], owner[keep]
        if len(codes):
            final = np.append(owner[1:] != owner[:-1], True)
            codes, owner = codes[~(final & (codes == 1))], owner[~(final & (codes == 1))]
        n = np.bincount(owner, minlength=len(texts))
        blocks = -(-n // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (np.cumsum(n) - n)[text] + nth * BLOCK
        size = np.minimum(BLOCK, n[text] - nth * BLOCK)
        out, codes = np.zeros((len(texts), len(self.model.langs)), np.int64), codes.astype(np.int64)
        for k, table in enumerate(self.model.tables):
            out[:, k] = np.bincount(text, weights=self._phrases(table, codes, at, size, nth), minlength=len(texts))
        return out, np.bincount(owner[codes != 1], minlength=len(texts))

    def _step(self, flat, width, state, c):
        """The states after characters c, and where a phrase begins: no longer phrase goes on, or an unknown letter came before."""
        to = flat[state * width + c].astype(self.np.int64)
        none = to == 0
        begins = none | (state == 0)
        again = self.np.flatnonzero(none)
        to[again] = flat[c[again]]
        return to, begins

    def _phrases(self, table, codes, at, size, nth):
        """Phrases that begin in each block."""
        np = self.np
        flat, width = table.ravel(), table.shape[1]
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, BLOCK + 1), side="right")  # blocks that have a character t
        # In this order, the blocks that have a character t are the first live[t].
        state, begun, first = np.zeros(len(at), np.int64), np.zeros((BLOCK, len(at)), bool), at[order]
        for t, m in enumerate(live.tolist()):
            if not m:
                break
            state[:m], begun[t, :m] = self._step(flat, width, state[:m], codes[first[:m] + t])
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        upto = np.cumsum(begun, axis=0, dtype=np.int16)
        every = upto[-1, place].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        phrases, meant = every.copy(), state[place]
        end, todo = meant, np.flatnonzero(nth > 0)
        while len(todo):
            block, s, own, t = todo, end[todo - 1], np.zeros(len(todo), np.int64), 0
            after, row = end[todo], np.arange(len(todo))
            while len(block):
                to, begins = self._step(flat, width, s, codes[at[block] + t])
                own += begins
                met = begins & begun[t, place[block]]
                over = size[block] == t + 1
                over &= ~met
                if met.any() or over.any():
                    b = block[met]
                    phrases[b] = own[met] + every[b] - upto[t, place[b]]
                    after[row[met]] = meant[b]
                    phrases[block[over]] = own[over]
                    after[row[over]] = to[over]
                    left = ~(met | over)
                    block, s, own, row = block[left], to[left], own[left], row[left]
                else:
                    s = to
                t += 1
            new = after != end[todo]
            end = end.copy()
            end[todo] = after
            # The blocks after those that end otherwise than was thought.
            following = todo[new] + 1
            following = following[following < len(at)]
            todo = following[nth[following] > 0]
        return phrases

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, bits a letter, and whether no learned language explains the text."""
        np = self.np
        if not self.model.langs:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [False] * len(texts)
        phrases, n = self.counts(texts)
        cost = phrases * self.model.bits
        best = cost.argmin(axis=1)
        one = cost[np.arange(len(texts)), best]
        if len(self.model.langs) > 1:
            cost[np.arange(len(texts)), best] = np.inf
            two = cost.min(axis=1)
            score = np.where(two > 0, 1 - one / np.where(two > 0, two, 1), 0.0)
        else:
            score = np.ones(len(texts))
        lang = [self.model.langs[b] if k else UND for b, k in zip(best, n, strict=True)]
        # The first phrase is free, or very short texts would look foreign.
        bits = np.where(n > 0, one - self.model.bits[best], 0.0)
        foreign = bits > FOREIGN_BITS * n + FOREIGN_START
        return lang, np.where(n > 0, np.clip(score, 0, 1), 0.0).tolist(), (bits / np.maximum(n, 1)).tolist(), foreign.tolist()


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """From labelled rows that are not held out."""
    bounded_batches(df.sparkSession)
    key = F.col(f"`{id_col}`")
    rows = df.where(F.col(f"`{lang}`").isNotNull() & key.isNotNull() & ~held_out(key)).select(F.md5(key.cast("string")).alias("h"), key.cast("string").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    frequency = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(frequency) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    short = rows.where(F.length("text").between(1, LONGEST))
    # The limit works by task, by language and part, and by language, so that a common language gathers in no task; texts come after it.
    few = short.select("lang", "h", "id").withColumn("part", F.substring("h", 1, 1))
    for by in (["lang", "part"], ["lang"]):
        few = few.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where(F.col("at") <= sample_docs)
    few = few.select("lang", "id").distinct()
    picked = short.join(F.broadcast(few), ["lang", "id"])  # at most sample_docs rows for each of at most LANGUAGES languages
    w = Window.partitionBy("lang").orderBy("h", "id", "text")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Texts that come after four times the bound stay where they are.
    picked = picked.withColumns({"before": before, "at": F.row_number().over(w)}).where((F.col("at") <= sample_docs) & (F.col("before") < 4 * train_chars)).orderBy("lang", "at").collect()
    samples: dict[str, str] = {}
    for r in picked:
        have = samples.get(r["lang"], "")
        more = letters(r["text"])
        if more and len(have) + len(more) <= max(train_chars, len(more) if not have else 0):
            samples[r["lang"]] = f"{have} {more}" if have else more
    if missing := sorted(set(frequency) - set(samples)):
        samples |= _from_shortest(rows.where(F.col("lang").isin(missing)), sample_docs, train_chars)
    return Model(samples, frequency)


def _from_shortest(rows: DataFrame, sample_docs: int, train_chars: int) -> dict[str, str]:
    """Samples of languages from their shortest texts that have a letter; a text that is longer by itself gives its first letters."""
    some = rows.where(F.col("text").rlike(r"\p{L}"))
    sized = some.select("lang", F.length("text").alias("size"), "h", "id").withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("size", "h", "id"))).where(F.col("at") <= sample_docs)
    picked = some.withColumn("size", F.length("text")).join(F.broadcast(sized.select("lang", "id", "size").distinct()), ["lang", "id", "size"])
    picked = picked.select("lang", "size", "h", "id", F.substring(F.regexp_replace("text", r"\P{L}+", " "), 1, train_chars + 1).alias("text"))
    # Texts that come after the bound is reached stay where they are.
    w = Window.partitionBy("lang").orderBy("size", "h", "id", "text")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = picked.withColumns({"before": before, "at": F.row_number().over(w)}).where((F.col("before") < train_chars) & (F.col("at") <= sample_docs)).orderBy("lang", "at").collect()
    samples: dict[str, str] = {}
    for r in picked:
        have, more = samples.get(r["lang"], ""), letters(r["text"])[:train_chars].rstrip()
        if more and len(have) + len(more) <= train_chars:
            samples[r["lang"]] = f"{have} {more}" if have else more
    return samples


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score, bits (per letter, in the predicted language) and foreign (too many bits)."""
    import pyarrow as pa

    spark = df.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # languages x TRAIN_CHARS bound its size
    name = uuid.uuid4().hex
    df = without(df, "lang_pred", "score", "bits", "foreign")
    schema = StructType(list(df.schema.fields)).add("lang_pred", "string").add("score", "double").add("bits", "double").add("foreign", "boolean")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held_by_worker(name, lambda: Parser(sent.value))
        for b in batches:
            texts, at = b.column(text).to_pylist(), 0
            cols: tuple[list, list, list, list] = ([], [], [], [])
            while at < len(texts):
                start, held = at, 0
                while at < len(texts) and held < 2_000_000:
                    held += len(texts[at] or "")
                    at += 1
                for c, v in zip(cols, parser.predict(texts[start:at]), strict=True):
                    c += v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=names)

    return df.mapInArrow(lambda batches: releasing(run(batches)), schema)


def identify(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = train(df, id_col, text, lang)
    key = F.col(f"`{id_col}`")
    rows = df.select(key.cast("bigint").alias("doc_id"), held_out(key).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
