"""Constants that carry meaning for results.

Everything in the FIXED VALUES block must equal the behaviour this engine
reproduces (class names, code tables, thresholds, message texts); changing
any of them changes results.
"""

from __future__ import annotations

# ───────────────────────────── FIXED VALUES ─────────────────────────────

# Drift detection
Z_SCORE_THRESHOLD = 2.0
BASELINE_FRACTION = 0.20
MIN_HISTORY = 3
FLAT_STD_EPSILON = 1e-6

# Label index used by the models: alphabetical class order
LABEL_ORDER = ["Excelling", "High Risk", "Moderate Risk", "On Track"]
# Trajectory value of each class
RISK_NUMERIC = {"High Risk": 1, "Moderate Risk": 2, "On Track": 3, "Excelling": 4}

# The 14 model features, in training order
FEATURES = [
    "gender", "age_band", "region", "highest_education",
    "imd_band", "disability", "num_of_prev_attempts",
    "studied_credits", "weighted_avg_score", "sum_clicks",
    "avg_clicks_per_day", "days_active", "last_active_day",
    "click_trend",
]
# The 8 columns that are standard-scaled; the 6 categorical codes are not
SCALED_FEATURES = [
    "num_of_prev_attempts", "studied_credits",
    "weighted_avg_score", "sum_clicks",
    "avg_clicks_per_day", "days_active",
    "last_active_day", "click_trend",
]
CATEGORICAL_FEATURES = ["gender", "age_band", "region", "highest_education",
                        "imd_band", "disability"]
ENGAGEMENT_FILL = ["weighted_avg_score", "sum_clicks", "avg_clicks_per_day",
                   "days_active", "last_active_day", "click_trend"]

STUDENT_KEYS = ["code_module", "code_presentation", "id_student"]

# Code tables: (mapping, default when the text is not in the mapping)
GENDER_CODES = ({"M": 0, "F": 1}, 0)
AGE_CODES = ({"0-35": 0, "35-55": 1, "55<=": 2}, 0)
EDUCATION_CODES = ({
    "No Formal quals": 0,
    "Lower Than A Level": 1,
    "A Level or Equivalent": 2,
    "HE Qualification": 3,
    "Post Graduate Qualification": 4,
}, 1)
IMD_CODES = ({
    "0-10%": 0, "10-20": 1, "10-20%": 1, "20-30%": 2, "30-40%": 3,
    "40-50%": 4, "50-60%": 5, "60-70%": 6, "70-80%": 7,
    "80-90%": 8, "90-100%": 9,
}, 5)
DISABILITY_CODES = ({"Y": 1, "N": 0}, 0)

# Outcome of the course -> risk class; other outcomes are dropped
TARGET_MAP = {
    "Distinction": "Excelling",
    "Pass": "On Track",
    "Withdrawn": "Moderate Risk",
    "Fail": "High Risk",
}

# Model hyper-parameters
RF_TREES = 200
RF_IMPURITY = "entropy"
GBT_ROUNDS = 100
GBT_STEP = 0.05
GBT_DEPTH = 4
SEED = 42
TEST_FRACTION = 0.20

# Drift log messages (format placeholders are filled per row)
MSG_SHORT_HISTORY = "Insufficient history for drift detection (need at least 3 weeks)."
# {mean} is shown with 1 decimal, {z} with 2, {threshold} as written here
MSG_DROP = ("⚠️ Engagement dropped significantly this week. "
            "Current clicks: {current}, Baseline average: {mean}, "
            "Z-score: {z} (>{threshold} standard deviations below normal).")
MSG_RISE = ("📈 Engagement increased significantly this week. "
            "Current clicks: {current}, Baseline average: {mean}, "
            "Z-score: {z}.")
MSG_NORMAL = "✅ Engagement is within normal range. Z-score: {z}."

# Factor suggestions: feature -> (text when the attribution is <= 0 ("low"),
#                                 text when it is > 0 ("high"))
SUGGESTIONS = {
    "sum_clicks": (
        "Student has low LMS interaction. Recommend sending course reminder email.",
        "Student is actively engaging with the LMS. Keep up the good work!"),
    "weighted_avg_score": (
        "Assessment scores are declining. Schedule a one-on-one session.",
        "Assessment performance is strong. Consider advanced materials."),
    "days_active": (
        "Student has not logged in recently. Send engagement nudge.",
        "Student is consistently active. Positive sign!"),
    "click_trend": (
        "Weekly activity is decreasing. Check if student needs support.",
        "Activity trend is positive — student is increasingly engaged."),
    "num_of_prev_attempts": (
        "First attempt at this course.",
        "Student has retaken before. Provide additional learning resources."),
    "avg_clicks_per_day": (
        "Daily engagement is very low. Consider a personalized study plan.",
        "Good daily engagement levels."),
    "last_active_day": (
        "Student stopped engaging early in the course. Urgent follow-up needed.",
        "Student was active until recently."),
    "studied_credits": (
        "Light course load may indicate part-time status.",
        "Heavy course load — check if student is overwhelmed."),
    "gender": (
        "Gender factor — consider if support programs are needed.",
        "Gender factor — consider if support programs are needed."),
    "age_band": (
        "Younger student — may benefit from study skills workshops.",
        "Mature student — may have work/family commitments to consider."),
    "region": (
        "Regional factor detected.",
        "Regional factor detected."),
    "highest_education": (
        "Lower prior education — may need foundational support.",
        "Strong educational background."),
    "imd_band": (
        "Student from a more deprived area. Check if financial support is available.",
        "Socioeconomic factor is positive."),
    "disability": (
        "No disability reported.",
        "Student has a disability. Ensure accessibility accommodations are in place."),
}
DEFAULT_SUGGESTION = "Feature '{feature}' is influencing the prediction."

# Student notices, by risk class (unknown classes use "On Track")
MOTIVATIONAL = {
    "Excelling": ("🌟", "Outstanding work! You're performing exceptionally. Keep this momentum — your dedication is truly inspiring. Consider helping peers who might need support!"),
    "On Track": ("👍", "You're doing great! You're on the right path. Keep maintaining your consistent effort — small improvements each day lead to big results!"),
    "Moderate Risk": ("💪", "You've got potential — let's unlock it! A bit more focus can make a big difference. Reach out to your teacher or peers for support. You can turn this around!"),
    "High Risk": ("🤝", "We're here for you. Everyone faces tough times, and what matters is taking that first step forward. Talk to your teacher, visit office hours, or connect with a study group. You CAN do this!"),
}
DRIFT_BANNER = ("⚠️ **Engagement drop detected.** Our system noticed a significant change "
                "in your activity. Please reach out to your teacher for support.")

# Alert texts
ALERT_TEACHER_SUBJECT = "Alert: {name} needs attention"
ALERT_STUDENT_SUBJECT = "Your learning activity this week"
ALERT_NO_FACTORS = "  No specific factors identified.\n"

# ───────────────────────── end of FIXED VALUES ─────────────────────────

STATUS_STATIC = "Static"
STATUS_DYNAMIC = "Dynamic Risk"
UNKNOWN = "Unknown"
