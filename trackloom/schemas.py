"""Row layouts shared by the batch and streaming operators."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
KEYPOINT = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("x", "y", "conf")]
)
LANDMARK = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "conf")]
)

FRAMES = T.StructType([
    T.StructField("slot_id", T.IntegerType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("ts", T.DoubleType()),
])

DETECTIONS = T.StructType(FRAMES.fields + [
    T.StructField("det_idx", T.IntegerType()),
    T.StructField("class_id", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
    T.StructField("polygon", T.ArrayType(POINT)),
    T.StructField("keypoints", T.ArrayType(KEYPOINT)),
    T.StructField("color_hist", T.ArrayType(T.DoubleType())),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("track_id", T.LongType()),
    T.StructField("track_state", T.StringType()),
    T.StructField("track_hits", T.IntegerType()),
    T.StructField("track_misses", T.IntegerType()),
    T.StructField("predicted_only", T.BooleanType()),
])

SNAPSHOT_REQUIRED = [
    ("target_id", "bigint"), ("local_id", "bigint"), ("global_id", "bigint"),
    ("label", "string"), ("confidence", "double"), ("cx", "double"), ("cy", "double"),
    ("vx", "double"), ("vy", "double"), ("width", "double"), ("height", "double"),
    ("timestamp", "double"),
]
SNAPSHOT_OPTIONAL = [
    ("camera_id", "int"), ("metadata", "map<string,string>"),
    ("attributes", "map<string,string>"), ("gesture", "string"),
    ("rect", "struct<x1:double,y1:double,x2:double,y2:double>"), ("health", "double"),
]
SNAPSHOTS_DDL = ", ".join(f"`{n}` {t}" for n, t in SNAPSHOT_REQUIRED + SNAPSHOT_OPTIONAL)
