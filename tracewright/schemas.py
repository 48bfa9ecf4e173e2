"""Fixed schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

QUESTIONS = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
])

RAW_QUESTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("answer", T.StringType()),
])


def _result_blob(score: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("records", T.ArrayType(T.StructType([
            T.StructField("index", T.StringType()),
            T.StructField("prompt", T.StringType()),
            T.StructField("origin_query", T.StringType()),
            T.StructField("ground_truth", T.StringType()),
            T.StructField("score", score),  # numbers, numbers as text, and truth values occur
        ]))),
    ])


RESULT_BLOB = _result_blob(T.StringType())
# As files are read: each number or truth value that is read as text costs a seek in the file, a variant costs none.
RESULT_FILE = _result_blob(T.VariantType())

POOL_LABELS = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("correct", T.IntegerType()),
])

SAMPLES = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("correct", T.IntegerType()),
    T.StructField("raw_generation", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
])

ERRORS = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

API_RESPONSE = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("content", T.StringType()),
            T.StructField("reasoning_content", T.StringType()),
            T.StructField("reasoning", T.StringType()),
        ])),
        T.StructField("finish_reason", T.StringType()),
    ]))),
])

MATRIX = T.ArrayType(T.ArrayType(T.FloatType()))
CUBE = T.ArrayType(MATRIX)

TRACE_COMMON = [
    T.StructField("qid", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("seq_len", T.IntegerType()),
    T.StructField("num_layers_incl_embed", T.IntegerType()),
    T.StructField("correct", T.IntegerType()),
    T.StructField("raw_generation", T.StringType()),
    T.StructField("n_new_tokens", T.IntegerType()),
    T.StructField("hit_max_new_tokens", T.BooleanType()),
]

TRACE_SINGLE = T.StructType(TRACE_COMMON + [
    T.StructField("token_pos", T.StringType()),
    T.StructField("hidden_all_layers", MATRIX),
])

TRACE_POSITIONS = T.StructType(TRACE_COMMON + [
    T.StructField("all_positions", T.BooleanType()),
    T.StructField("requested_token_positions", T.ArrayType(T.IntegerType())),
    T.StructField("available_token_positions", T.ArrayType(T.IntegerType())),
    T.StructField("hidden_states_by_position", CUBE),
])

TRACE_DECODE = T.StructType(TRACE_COMMON + [
    T.StructField("decode_hidden_states_by_step", CUBE),
    T.StructField("decode_step_indices", T.ArrayType(T.IntegerType())),
    T.StructField("decode_layers_captured", T.ArrayType(T.IntegerType())),
    T.StructField("decode_stride", T.IntegerType()),
    T.StructField("n_decode_samples_captured", T.IntegerType()),
    T.StructField("generated_token_ids", T.ArrayType(T.IntegerType())),
])

TRACE_LOGITS = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("correct", T.IntegerType()),
    T.StructField("logits_per_step", MATRIX),
    T.StructField("answer_token_id", T.IntegerType()),
])

# One vector per row: the table every trajectory operator works on.
TRAJECTORY = ["qid", "sample_idx", "layer"]
STATES = T.StructType([
    T.StructField("qid", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("step_index", T.IntegerType()),
    T.StructField("n_steps", T.IntegerType()),
    T.StructField("n_new_tokens", T.IntegerType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())),
])

PCA_BASIS = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_traces", T.StringType()),
    T.StructField("n_fit_samples", T.LongType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("explained_variance_ratio", T.ArrayType(T.DoubleType())),
])
