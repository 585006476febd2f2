from tidemark.operators import library


def test_paths_of_a_deep_tree(spark):
    rows = [("n0", None), *((f"n{i}", f"n{i - 1}") for i in range(1, 36)), ("x", "y"), ("y", "x"), ("o", "gone")]
    got = {r.node: (r.root, r.depth, len(r.path)) for r in library.tree_paths(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert got == {f"n{i}": ("n0", i, i + 1) for i in range(36)}
