"""Column roles, dictionaries, labels and thresholds.

Everything below the "FIXED VALUES" marker must equal the values of the
project this library re-implements, because models, stored feature lists
and the request contract depend on them. They are data, kept together here
in their natural order; operators receive them as parameters.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (data contract; do not edit without migrating stored models)
# ---------------------------------------------------------------------------

# Survey (basic) table.
BASIC_TARGET_RAW = "HeartDiseaseorAttack"
TARGET = "target"
BASIC_BINARY_COLS = [
    "HighBP", "HighChol", "CholCheck", "Smoker", "Stroke", "PhysActivity",
    "Fruits", "Veggies", "HvyAlcoholConsump", "AnyHealthcare", "NoDocbcCost",
    "DiffWalk", "Sex",
]
BASIC_ORDINAL_COLS = ["GenHlth", "Age", "Education", "Income", "Diabetes"]
BASIC_NUMERIC_COLS = ["BMI", "MentHlth", "PhysHlth"]
BASIC_SCALE_COLS = [
    "BMI", "MentHlth", "PhysHlth", "GenHlth", "Age", "Education", "Income", "Diabetes",
]
BASIC_FEATURES = [
    "HighBP", "HighChol", "CholCheck", "BMI", "Smoker", "Stroke", "Diabetes",
    "PhysActivity", "Fruits", "Veggies", "HvyAlcoholConsump", "AnyHealthcare",
    "NoDocbcCost", "GenHlth", "MentHlth", "PhysHlth", "DiffWalk", "Sex", "Age",
    "Education", "Income",
]

# Clinical (advanced) table.
ADVANCED_TARGET_RAW = "num"
ADVANCED_DROP_COLS = ["id", "dataset"]
ADVANCED_BOOLEAN_COLS = ["fbs", "exang"]
ADVANCED_MEDIAN_COLS = ["trestbps", "chol", "thalch", "oldpeak"]
ADVANCED_MODE_COLS = ["restecg", "fbs", "exang"]
ADVANCED_UNKNOWN_COLS = ["slope", "thal"]
ADVANCED_MINUS_ONE_COLS = ["ca"]
UNKNOWN_TEXT = "unknown"
MISSING_NUMBER = -1
ADVANCED_LOW_IMPORTANCE_COLS = ["trestbps", "restecg", "slope"]
ADVANCED_NUMERIC_COLS = ["age", "chol", "thalch", "oldpeak", "ca"]
ADVANCED_CATEGORICAL_COLS = ["sex", "cp", "thal"]
ADVANCED_FEATURES = [
    "age", "chol", "fbs", "thalch", "exang", "oldpeak", "ca", "sex_Male",
    "cp_atypical angina", "cp_non-anginal", "cp_typical angina", "thal_normal",
    "thal_reversable defect", "thal_unknown",
]
# Feature-selection experiment lists (differ from the ones above on purpose).
EXPERIMENT_NUMERIC_COLS = ["age", "trestbps", "chol", "thalch", "oldpeak", "ca"]
EXPERIMENT_CATEGORICAL_COLS = ["sex", "cp", "restecg", "slope", "thal"]

# Training settings.
TEST_SIZE = 0.2
RANDOM_STATE = 42
CV_FOLDS = 5
PERMUTATION_REPEATS = 30
FOREST_BASIC_LOCAL = {"n_estimators": 300, "max_depth": 10, "class_weight": "balanced"}
FOREST_BASIC_PROD = {"n_estimators": 500, "max_depth": 12, "class_weight": "balanced"}
FOREST_ADVANCED_LOCAL = {"n_estimators": 300, "max_depth": 8, "class_weight": "balanced"}
FOREST_ADVANCED_PROD = {"n_estimators": 500, "max_depth": 10, "class_weight": "balanced"}

# Serving rules.
DECISION_THRESHOLD = 0.5
RISK_LOW_BELOW = 0.3
RISK_MEDIUM_BELOW = 0.6
RISK_LEVELS = ["Low", "Medium", "High"]
TOP_CONTRIBUTORS = 8
PROBABILITY_DECIMALS = 4

# Request ordinal dictionaries (key -> code), natural order.
AGE_GROUP_CODES = [
    ("18-24", 1), ("25-29", 2), ("30-34", 3), ("35-39", 4), ("40-44", 5),
    ("45-49", 6), ("50-54", 7), ("55-59", 8), ("60-64", 9), ("65-69", 10),
    ("70-74", 11), ("75-79", 12), ("80+", 13),
]
DIABETES_CODES = [("Không", 0), ("Tiền tiểu đường", 1), ("Có", 2)]
GEN_HEALTH_CODES = [("Rất tốt", 1), ("Tốt", 2), ("Khá", 3), ("Trung bình", 4), ("Kém", 5)]
EDUCATION_CODES = [
    ("Chưa học/Tiểu học", 1),
    ("Trung học cơ sở", 2),
    ("Trung học phổ thông (chưa tốt nghiệp)", 3),
    ("Tốt nghiệp THPT", 4),
    ("Cao đẳng/Đại học (chưa tốt nghiệp)", 5),
    ("Tốt nghiệp Đại học", 6),
]
INCOME_CODES = [
    ("<10k", 1), ("10-15k", 2), ("15-20k", 3), ("20-25k", 4), ("25-35k", 5),
    ("35-50k", 6), ("50-75k", 7), (">75k", 8),
]
# English aliases accepted for the same codes (used by the request fixtures).
DIABETES_ALIASES = [("no", 0), ("pre", 1), ("yes", 2)]
GEN_HEALTH_ALIASES = [("very good", 1), ("good", 2), ("fair", 3), ("average", 4), ("poor", 5)]
EDUCATION_ALIASES = [
    ("none", 1), ("lower secondary", 2), ("some upper secondary", 3),
    ("upper secondary", 4), ("some college", 5), ("degree", 6),
]

# Request enumerations.
SEX_VALUES = ["Male", "Female"]
CP_VALUES = ["typical angina", "atypical angina", "non-anginal", "asymptomatic"]
THAL_VALUES = ["normal", "fixed defect", "reversable defect"]
CHAT_MODES = ["basic", "advanced"]
CHAT_ROLES = ["user", "assistant"]

# Display strings used in responses.
YES_TEXT = "Có"
NO_TEXT = "Không"
MALE_TEXT = "Nam"
FEMALE_TEXT = "Nữ"
NO_RESULT_TEXT = "Không có kết quả"
CHOL_UNIT_SUFFIX = " mg/dl"

# Feature display labels, basic then advanced.
BASIC_FEATURE_LABELS = [
    ("HighBP", "Cao huyết áp"),
    ("HighChol", "Cholesterol cao"),
    ("CholCheck", "Đã kiểm tra cholesterol (5 năm qua)"),
    ("BMI", "Chỉ số BMI"),
    ("Smoker", "Hút thuốc"),
    ("Stroke", "Từng đột quỵ"),
    ("Diabetes", "Tiểu đường"),
    ("PhysActivity", "Vận động thể chất thường xuyên"),
    ("Fruits", "Ăn trái cây hàng ngày"),
    ("Veggies", "Ăn rau củ hàng ngày"),
    ("HvyAlcoholConsump", "Uống rượu bia nhiều"),
    ("AnyHealthcare", "Có bảo hiểm y tế"),
    ("NoDocbcCost", "Từng bỏ khám vì chi phí"),
    ("GenHlth", "Tự đánh giá sức khỏe"),
    ("MentHlth", "Số ngày không ổn tinh thần (30 ngày)"),
    ("PhysHlth", "Số ngày không khỏe thể chất (30 ngày)"),
    ("DiffWalk", "Khó đi bộ/leo cầu thang"),
    ("Sex", "Giới tính"),
    ("Age", "Nhóm tuổi"),
    ("Education", "Trình độ học vấn"),
    ("Income", "Thu nhập hộ gia đình/năm"),
]
ADVANCED_FEATURE_LABELS = [
    ("age", "Tuổi"),
    ("chol", "Cholesterol huyết thanh"),
    ("thalch", "Nhịp tim tối đa đạt được"),
    ("oldpeak", "ST depression (oldpeak)"),
    ("ca", "Số mạch máu chính bị hẹp"),
    ("fbs", "Đường huyết lúc đói > 120mg/dl"),
    ("exang", "Đau ngực khi vận động gắng sức"),
    ("sex_Male", "Giới tính Nam"),
    ("cp_atypical angina", "Đau ngực không điển hình"),
    ("cp_non-anginal", "Đau ngực không do tim"),
    ("cp_typical angina", "Đau thắt ngực điển hình"),
    ("thal_normal", "Xạ hình thallium: bình thường"),
    ("thal_reversable defect", "Xạ hình thallium: khiếm khuyết phục hồi được"),
    ("thal_unknown", "Xạ hình thallium: không có kết quả"),
]

# Usage dashboard labels.
RISK_LABELS = [("Low", "Thấp"), ("Medium", "Trung bình"), ("High", "Cao")]
MODE_LABELS = [("basic", "Sàng lọc nhanh"), ("advanced", "Nâng cao")]

# Retrieval.
RETRIEVAL_TOP_K = 3
RELEVANCE_THRESHOLD = 0.5
ZERO_NORM_DENOMINATOR = 1e-10
HISTORY_KEEP = 12
CHUNK_SPLIT_PATTERN = r"\n(?=## )"
TITLE_PREFIX = "# "

# Characters Python's str.strip() removes (str.isspace): as a set, and as a
# regex class valid in both Java regex and RE2.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
    "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# ---------------------------------------------------------------------------
# Our own parameters (not part of the reference contract)
# ---------------------------------------------------------------------------

# Largest one-hot vocabulary per column before encoding refuses to run.
MAX_ONEHOT_WIDTH = 1024
# Largest number of rows a lookup/stats table may have to be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
# Query vectors scored per broadcast block in retrieval.
MAX_QUERY_BLOCK = 4096
