"""Decoders that go on as their streams do: runs that arrive in any order come out step by step, and songs note by note, as
they are pulled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.huffman import group_reader
from ..functions.lz import NO_END, pull

ROW = "cell long, pos long, symbol string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the state store that several state variables need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunDecoder(StatefulProcessor):
    """State of a cell: the number of the run that is to come, the step it starts at, and runs that came before their turn.

    A run whose number is below the one to come has been decoded and is passed over, so a stream that repeats runs gives
    each step once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "run long, pos long")
        self.early = handle.getMapState("early", "run long", "symbol string, run_len long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        run, pos = self.at.get() if self.at.exists() else (1, 0)
        waiting: dict[int, tuple[str, int]] = {}
        for part in rows:
            for r, s, n in zip(part["run"], part["symbol"], part["run_len"]):
                if r >= run:
                    waiting[int(r)] = (s, int(n))
        out: list[tuple[int, str, int]] = []
        while run in waiting or self.early.containsKey((run,)):
            if run in waiting:
                symbol, n = waiting.pop(run)
            else:
                symbol, n = self.early.getValue((run,))
                self.early.removeKey((run,))
            out.append((pos, symbol, n))
            run, pos = run + 1, pos + n
        for r, v in waiting.items():
            self.early.updateValue((r,), v)
        self.at.update((run, pos))
        for start, symbol, n in out:
            yield pd.DataFrame({"cell": [key[0]] * n, "pos": range(start, start + n), "symbol": [symbol] * n})

    def close(self) -> None:
        pass


class NotePuller(StatefulProcessor):
    """State of a song: its bits, where its reader is, the references that are open there, and how many notes were pulled.

    A row either brings the song's bits or asks for notes. What is asked for before the bits are there is given once they
    are, and a song that has ended gives no more.
    """

    def __init__(self, trees: list[list[tuple]]):
        self.trees = trees

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.song = handle.getValueState("song", "bits string, n long")
        self.place = handle.getValueState("place", "bit long, left long, pulled long, owed long")
        self.open = handle.getListState("open", "bit long, left long")
        self.read = group_reader(self.trees)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        bit, left, pulled, owed = self.place.get() if self.place.exists() else (0, NO_END, 0, 0)
        for part in rows:
            for bits, n, ask in zip(part["bits"], part["n"], part["ask"]):
                if isinstance(bits, str):
                    self.song.update((bits, int(n)))
                owed += int(ask)
        out = []
        if self.song.exists():
            bits, n = self.song.get()
            place = (bit, left, [tuple(x) for x in self.open.get()] if self.open.exists() else [])
            while owed and pulled < n:
                (note, rest), place = pull(bits, place, self.read)
                out.append((key[0], pulled, note, rest >> 3, rest & 7))
                pulled, owed = pulled + 1, owed - 1
            bit, left = place[:2]
            if place[2]:
                self.open.put(place[2])
            else:
                self.open.clear()
        self.place.update((bit, left, pulled, owed))
        yield pd.DataFrame(out, columns=["conv_id", "place", "note", "len", "run"])

    def close(self) -> None:
        pass


def pulled(asks: DataFrame, trees: list[list[tuple]]) -> DataFrame:
    """(conv_id, place, note, len, run) of a stream of songs and pulls (conv_id, bits, n, ask)."""
    rows = asks.select("conv_id", "bits", "n", "ask").groupBy("conv_id")
    return rows.transformWithStateInPandas(statefulProcessor=NotePuller(trees), outputStructType="conv_id long, place long, note int, len int, run int", outputMode="Append", timeMode="None")


def decoded(runs: DataFrame) -> DataFrame:
    """(cell, pos, symbol) of a stream of runs (cell, run, symbol, run_len), whose numbers count from 1 in each cell."""
    rows = runs.select("cell", "run", "symbol", "run_len").groupBy("cell")
    return rows.transformWithStateInPandas(statefulProcessor=RunDecoder(), outputStructType=ROW, outputMode="Append", timeMode="None")


def with_rocksdb(spark: SparkSession, run):
    """run() while the session's streams keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before)
