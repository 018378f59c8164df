"""Word lists, thresholds and texts that define the results.

Everything here must keep exactly these values for results to be comparable.
"""

# --- status words (case-insensitive substrings) -----------------------------
ACTIVE_WORDS = ["booked", "planned", "awaiting", "rts", "request", "sent"]
CANCELLED_WORDS = ["cancel", "postponed"]
COMPLETED_WORDS = ["down", "completed", "complete", "closed", "handed over"]
PRIORITY_STATUS_PATTERN = "cancel|postponed|down|completed|complete|closed"

# --- target name hints ------------------------------------------------------
IDENTIFIER_WORDS = ["id", "uuid", "guid", "number", "no", "name"]
DATE_TARGET_WORDS = ["date", "time", "created", "updated", "completed", "due"]
DATE_FEATURE_WORDS = ["date", "time", "created", "updated", "due", "completed"]

# --- target profile limits --------------------------------------------------
MIN_TARGET_ROWS = 30
MAX_CLASSES = 80
MAX_UNIQUE_RATIO = 0.35
MAX_CLASSIFICATION_NUMBERS = 20

# --- feature limits ---------------------------------------------------------
SPARSE_SHARE = 0.98
HIGH_CARDINALITY = 5000
RARE_SHARE = 0.01
SIGNATURE_CATEGORIES = 25

# --- yes/no spellings -------------------------------------------------------
YES_TEXTS = ["yes", "y", "true", "t", "1"]
NO_TEXTS = ["no", "n", "false", "f", "0"]
BOOLEAN_TEXTS = ["0", "1", "0.0", "1.0"]

# --- domain columns ---------------------------------------------------------
DAMAGE_COLUMNS = ["c_damagestatus", "c_damagecategory", "c_damagedescription"]
PRIORITY_SIGNAL_COLUMNS = ["c_hscategory", "c_hsincidentdate", "c_damagestatus", "c_damagecategory"]
REQUIRED_COLUMNS = [
    "related_contacts", "c_homeownerpostcode", "c_scaffoldpurpose", "status", "date",
    "due_date", "budget_revenue",
]
KEEP_COLUMNS = [
    "project_no", "project_name", "contact_name", "date", "due_date", "completed_date",
    "status", "estimated_duration", "total_to_do", "total_done", "total_to_do_billable",
    "done_billable", "budget_revenue", "actual_revenue", "budget_cost", "actual_cost",
    "budget_labor_cost", "actual_labor_cost", "related_contacts", "c_homeownerpostcode",
    "c_creationdate", "c_erectdate", "c_installdate", "c_dismantledate",
    "c_locationofscaffold", "c_scotlandonlyloadnumeric", "c_scotlandonlyliftsnumeric",
    "c_scaffoldpurpose", "c_frontscaffoldheight", "c_frontscaffoldlength",
    "c_rearscaffoldheight", "c_rearscaffoldlength", "c_leftscaffoldheight",
    "c_leftscaffoldlength", "c_rightscaffoldheight", "c_rightscaffoldlength",
    "c_edgeprotection", "c_hirecharges", "c_hsincidentdate", "c_hscategory",
    "c_riddorreportable", "c_damagereporting", "c_damagestatus", "c_damageliability",
    "c_damagecategory", "c_damageresolutiondate", "c_damagecauseidentified",
]
DATE_COLUMNS = [
    "date", "due_date", "completed_date", "c_creationdate", "c_erectdate", "c_installdate",
    "c_dismantledate", "c_hsincidentdate", "c_damageresolutiondate",
]
NUMERIC_COLUMNS = [
    "estimated_duration", "total_to_do", "total_done", "total_to_do_billable",
    "done_billable", "budget_revenue", "actual_revenue", "budget_cost", "actual_cost",
    "budget_labor_cost", "actual_labor_cost", "c_scotlandonlyloadnumeric",
    "c_scotlandonlyliftsnumeric", "c_frontscaffoldheight", "c_frontscaffoldlength",
    "c_rearscaffoldheight", "c_rearscaffoldlength", "c_leftscaffoldheight",
    "c_leftscaffoldlength", "c_rightscaffoldheight", "c_rightscaffoldlength",
    "c_hirecharges", "c_riddorreportable",
]
PRIVATE_COLUMNS = [
    "id", "entity_id", "project_manager", "project_members", "description", "tags",
    "c_zendeskid", "c_clientreference", "c_shroudingref", "c_propertyownerinformation",
    "c_homeownername", "c_homeowneraddress", "c_w3w", "c_homepropertyphone",
    "c_homepropertyemail", "c_projectdatestimes", "c_scaffoldspecifics",
    "c_scaffoldspecification", "c_inspectedby", "c_siteaccess", "c_msadditionalcomments",
    "c_siterequirementsquote", "c_photo1", "c_photo2", "c_elevation", "c_siteaccessimage",
    "c_hscategorynotes", "c_damageticketid", "c_damagepartnerid", "c_damagedescription",
    "c_damagesreviewsummary", "c_damagefindings",
]

# --- prepared dataset policy ------------------------------------------------
PREPARE_TARGET_ROWS = 12000
PREPARE_TOP_TEAMS = 250
PREPARE_ROWS_PER_TEAM = 60
RANDOM_SEED = 42
LARGEST_SAFE_NUMBER = 1_000_000

# --- reference lists: column -> (list name, limit) --------------------------
REFERENCE_LISTS = {
    "project_manager": ("project_managers", 500),
    "budget_type": ("budget_types", 20),
    "status": ("current_statuses", 50),
    "c_scaffoldpurpose": ("scaffold_purposes", 200),
    "c_locationofscaffold": ("scaffold_locations", 500),
    "c_homeownerpostcode": ("postcodes", 2000),
}
ENTITY_LIST_LIMIT = 10000

# --- intake -----------------------------------------------------------------
PRICE_FIELDS = ["budget_revenue", "job_price", "price", "quoted_price"]
JOB_TYPE_FIELDS = ["c_scaffoldpurpose", "job_type", "scaffold_purpose"]
POSTCODE_FIELDS = ["c_homeownerpostcode", "postcode", "homeowner_postcode"]
START_FIELDS = ["date", "start_date"]
DUE_FIELDS = ["due_date", "install_date"]
REQUIRED_INPUTS = [
    ("related_contacts", "Scaffolder"),
    ("c_homeownerpostcode", "Postcode"),
    ("c_scaffoldpurpose", "Job type"),
    ("date", "Erect date"),
    ("due_date", "Install / due date"),
    ("budget_revenue", "Job price"),
]
SUGGESTION_COLUMNS = [
    "project_name", "contact_name", "related_contacts", "project_manager", "date",
    "due_date", "budget_type", "budget_revenue", "budget_cost", "actual_revenue",
    "actual_cost", "status", "description", "tags", "c_homeownerpostcode",
    "c_scaffoldpurpose",
]
SUGGESTION_REQUIRED = ["contact_name", "project_manager", "date", "due_date"]

# --- risk scores ------------------------------------------------------------
HIGH_RISK_WORDS = ["roof", "chimney", "edge", "gable", "height", "flue", "render", "brickwork"]
# signal name -> (high threshold, medium threshold, detail text)
RISK_SIGNALS = {
    "Failure / non-completion risk": (
        25, 12,
        "Combined risk that the job does not complete cleanly, using completion, cancellation and programme signals.",
    ),
    "HSE / incident risk": (
        8, 3,
        "Based on scaffolder incident history, RIDDOR flags, job type and short-notice pressure.",
    ),
    "Completion likelihood": (
        82, 65,
        "Likelihood the job follows the historic completed/scaffold-down pattern for this scaffolder and similar jobs.",
    ),
    "Cancellation / postponement risk": (
        18, 8,
        "Uses the scaffolder's historical cancellation/postponement pattern, adjusted for lead time.",
    ),
    "Programme risk": (
        22, 10,
        "Highlights risk from short lead times, historic non-completion and cancellation patterns.",
    ),
    "Damage / claim risk": (
        5, 2,
        "Based on historic damage status, category and description records for this scaffolder.",
    ),
    "Price / margin pressure": (
        35, 15,
        "Compares input price/cost against historic scaffolder job values and implied margin.",
    ),
}
RECOMMEND_HSE = "Request RAMS early and check handover/photo evidence before install."
RECOMMEND_PROGRAMME = "Confirm scaffolder availability and homeowner access before committing dates."
RECOMMEND_CANCELLATION = "Keep a backup scaffolder option live until booking is confirmed."
RECOMMEND_MARGIN = "Review price/cost before issue; this job may carry margin pressure."
RECOMMEND_DEFAULT = "Proceed with standard booking controls and normal handover checks."

# --- team leaderboard -------------------------------------------------------
CANDIDATE_TEAMS = 120
MIN_TEAM_JOBS = 8
TEAM_GATE_ROWS = 3
RISK_GATE_ROWS = 10
LEADERBOARD_ROWS = 8
REASON_FULL_MATCH = "Strong match across job type, area and price band."
REASON_TYPE_AND_PRICE = "Strong job-type and price-band match; limited area history."
REASON_TYPE_ONLY = "Strong job-type history; limited area evidence."
REASON_TYPE_HISTORY = "Strong job-type history; confirm area and commercial fit."
REASON_RELIABLE = "Reliable completion record with low cancellation pressure."
REASON_LIMITED = "Limited history; use tighter booking and handover checks."
REASON_MIXED = "Viable team with mixed matching signals."

# --- decisions --------------------------------------------------------------
DECISION_ESCALATE = "Escalate before booking"
DECISION_CONTROLS = "Proceed with controls"
DECISION_STANDARD = "Proceed standard"
STANDARD_PRIORITY = "Normal handover controls"
STANDARD_RATIONALE = "No elevated operational signal detected."
ASSESSMENT_LOG_ROWS = 40
ASSESSMENT_SHOWN_ROWS = 8

# --- drift ------------------------------------------------------------------
DRIFT_ALERT = 0.35

# --- target profile texts ---------------------------------------------------
REASON_FEW_DISTINCT = "Target has fewer than two distinct values."
REASON_FEW_NUMBERS = "Regression target needs at least five distinct numeric values."
REASON_IDENTIFIER_REGRESSION = "Target looks like an identifier or name rather than a measurable outcome."
REASON_IDENTIFIER_CLASS = "Target looks like an identifier or name rather than an outcome."
REASON_SINGLE_ROW_CLASS = "At least one class has only one row, so a stable train/test split is not possible."
REASON_MANY_CLASSES = (
    "Target has too many distinct classes for a useful classification model; choose a grouped outcome."
)
REASON_SPLIT_TOO_SMALL = "There are too many classes for the selected test size."
WARNING_DATE_REGRESSION = (
    "Date-like targets should usually be converted into duration or delay targets first."
)
WARNING_DATE_CLASS = (
    "Date-like targets usually perform better as engineered delay or duration outcomes."
)
