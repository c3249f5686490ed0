"""A second engine to hold the DataFrame engine against: MLlib's
``IndexedRowMatrix.computeSVD`` on An, its right factor on the driver."""

from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry
from pyspark.sql import functions as F

from cobi.functions.vectors import embedding_width, scale
from cobi.operators.matrix import degrees, normalize
from cobi.operators.numbering import number_nodes


def mllib_embedding(edges, k=5, discard="none"):
    """(sigma, embedding) with the first or last of the top r triplets dropped."""
    spark = edges.sparkSession
    rows = number_nodes(edges.select(F.col("first_field").alias("node")), id_col="i")
    cols = number_nodes(edges.select(F.col("second_field").alias("node")), id_col="j")
    coo = (normalize(edges).join(rows.withColumnRenamed("node", "first_field"), "first_field")
           .join(cols.withColumnRenamed("node", "second_field"), "second_field").select("i", "j", "w_norm"))
    entries = coo.rdd.map(lambda r: MatrixEntry(int(r[0]), int(r[1]), float(r[2])))
    mat = CoordinateMatrix(entries, rows.count(), cols.count()).toIndexedRowMatrix()
    svd = mat.computeSVD(embedding_width(k), computeU=True)
    sigma, V = svd.s.toArray(), svd.V.toArray()
    sel = {"none": slice(None), "first": slice(1, None), "last": slice(0, -1)}[discard]
    sel = list(range(len(sigma)))[sel]
    u = spark.createDataFrame(
        svd.U.rows.map(lambda r: (int(r.index), [float(r.vector[j]) for j in sel])), "i long, f array<double>")
    v = spark.createDataFrame([(j, [float(V[j, c]) for c in sel]) for j in range(V.shape[0])], "j long, f array<double>")
    deg = degrees(edges)
    out = [side.join(ids, on).join(deg.filter(F.col("side") == name), "node")
           .select("side", "node", scale(F.col("f"), 1 / F.sqrt("degree")).alias("embedding"))
           for side, ids, on, name in ((u, rows, "i", "row"), (v, cols, "j", "column"))]
    return sigma[sel], out[0].unionByName(out[1])
