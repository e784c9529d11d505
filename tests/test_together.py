import socket
from multiprocessing.connection import Connection

import pytest
from liftwork.operators import together


def test_messages_do_not_wait_for_an_acknowledgement():
    with socket.socket(socket.AF_INET, socket.SOCK_STREAM) as s:  # neither bound nor connected: no port
        together.at_once(Connection(s.dup().detach())).close()
        assert s.getsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY)


@pytest.mark.parametrize(("n", "tasks"), [(0, 1), (50_001, 2), (10**9, 8)])
def test_no_more_tasks_than_slots(spark, n, tasks):
    rows = spark.range(3)
    asked = together.in_tasks(rows, n, lambda peers, batches: batches, "id long")
    assert f"Repartition {tasks}, true" in asked._jdf.queryExecution().logical().toString()
