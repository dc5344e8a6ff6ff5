"""Large buckets whose nodes hang together with different pivots."""

from decoylens.llm import hyperminhash as H
from decoylens.llm.components import components


def test_links_between_the_crowds_of_different_pivots(spark, monkeypatch):
    monkeypatch.setattr(H, "TASK_NODES", 8)
    monkeypatch.setattr(H, "PIVOTS", 6)
    # Neighbours in this chain overlap by 0.81, others by 0.65 at most.
    texts = {i: " ".join(f"w{j}" for j in range(20 * i, 20 * i + 200)) for i in range(40)}
    sets = {i: H.shingle_set(t) for i, t in texts.items()}
    rows = [(i, len(s), bytearray(H.registers(s).tobytes()), [7]) for i, s in sets.items()]
    nodes = spark.createDataFrame(rows, "node long, n long, registers binary, bands array<long>")
    given = spark.createDataFrame([*texts.items()], "node long, text string")
    found = components(H.links(nodes, lambda wanted: given.join(wanted, "node"))).collect()
    assert len(found) == 40 and len({r["root"] for r in found}) == 1
