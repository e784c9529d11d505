"""Tasks of one barrier stage that work on their rows together: iterations without a job for each step.

Rows are dealt over the slots, a task for every `WORTH_A_TASK` of them; the stage needs its slots at once, as every barrier
stage does (and no dynamic allocation). If an executor is lost, Spark runs the whole stage again.
"""

from __future__ import annotations

import os
import secrets
import socket
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORTH_A_TASK = 50_000


def at_once(c: Connection) -> Connection:
    """`c`, sending what it is given without waiting. Longer messages go as a length and a body, and the body would wait 40 ms for the length's acknowledgement."""
    with socket.socket(fileno=os.dup(c.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return c


class Peers:
    """The tasks of a barrier stage, joined along a binary tree of authenticated connections."""

    def __init__(self, rank: int, hosts: list[str], exchange: Callable[[str], list[str]], key: bytes):
        self.rank, self.parent, self.children = rank, None, []
        if len(hosts) == 1:
            return
        below = [c for c in (2 * rank + 1, 2 * rank + 2) if c < len(hosts)]
        with Listener(("", 0), authkey=key, backlog=2) as door:
            ports = [int(p) for p in exchange(str(door.address[1]))]
            if rank:
                up = (rank - 1) // 2
                self.parent = at_once(Client((hosts[up], ports[up]), authkey=key))
            self.children = [at_once(door.accept()) for _ in below]

    def total(self, x: np.ndarray, join: Callable = np.add) -> np.ndarray:
        """The sum (or what `join` makes) of the arrays of all tasks, in all tasks."""
        for c in self.children:
            x = join(x, np.frombuffer(c.recv_bytes(), x.dtype).reshape(x.shape))
        if self.parent is not None:
            self.parent.send_bytes(np.ascontiguousarray(x).tobytes())
            x = np.frombuffer(self.parent.recv_bytes(), x.dtype).reshape(x.shape)
        for c in self.children:
            c.send_bytes(np.ascontiguousarray(x).tobytes())
        return x

    def close(self) -> None:
        for c in [*self.children, *([self.parent] if self.parent else [])]:
            c.close()


def in_tasks(rows: DataFrame, n: int, work: Callable[[Peers, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    """What `work` makes of the `n` rows in barrier tasks. tasks: by default one for every WORTH_A_TASK rows up to the slots, as a stage of more would be refused."""
    tasks = tasks or max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // WORTH_A_TASK)))
    key = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        peers = Peers(context.partitionId(), [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()], context.allGather, key)
        yield from work(peers, batches)
        peers.close()

    return rows.repartition(tasks).mapInArrow(run, schema, barrier=True)
