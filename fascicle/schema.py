"""Fixed vocabularies and table schemas."""

# Roles, actions, statuses and extensions as the data uses them.
ROLES = ("recording", "slides", "textbook", "lecture_material", "past_exam", "question_bank", "ignore", "reference", "handout")
ACTIONS = ("auto", "use", "use_remote", "convert", "ocr", "compress", "chunk", "ignore", "wait")
READY_STATUSES = ("", "ready", "processed", "queryable", "completed", "complete", "success")
STATUS_NUMBERS = {"1": "processing", "2": "ready", "3": "error", "5": "preparing"}
RECORDING_EXTENSIONS = (".m4a", ".mp3", ".wav", ".aac", ".mp4", ".mkv", ".ogg", ".webm", ".avi", ".mov")
SLIDE_EXTENSIONS = (".ppt", ".pptx", ".pps", ".ppsx")
UPLOAD_EXTENSIONS = (".pdf", ".pptx", ".docx", ".m4a", ".mp3", ".wav", ".aac", ".mp4", ".ogg")
PHASES = ("guide", "imp", "mcqs", "written", "cases")
CALLOUTS = ("NOTE", "IMPORTANT", "WARNING", "CAUTION", "TIP")
SECTION_HEADINGS = ("## 📖 Chronological Guide", "## 🌟 IMP Points", "## ❓ MCQs", "## ✍️ Written Questions", "## 🩺 Clinical Cases")
IMP_HEADINGS = ("#### 1. 📌 Doctor's Spoken Pearls", "#### 2. ⚠️ Diagnostic Traps", "#### 3. 🛑 Lethal Mistakes", "#### 4. ❓ Interactive Doctor Questions", "#### 5. 📋 Exam Rules")
REVIEW_MARKERS = ("NEEDS_SOURCE_REVIEW", "NEEDS_OCR_REVIEW", "UNRESOLVED_CONFLICT")
EMPTY_MARKERS = ("NO_GROUNDED_MCQS", "NO_GROUNDED_WRITTEN_QUESTIONS")
LEDGER_TRANSITIONS = {
    "manifest_ready": ("queued", "blocked"),
    "queued": ("running", "blocked", "failed"),
    "running": ("draft_ready", "blocked", "failed"),
    "draft_ready": ("running", "accepted", "blocked", "failed"),
    "accepted": ("finalized", "failed"),
    "finalized": ("verified", "failed"),
    "blocked": ("queued",),
    "failed": ("queued",),
    "verified": (),
}
CARD_KEYWORDS = (
    ("def", ("definition", "define", "what is")),
    ("TTT", ("treatment", "ttt", "management", "antidote", "contraindication", "protocol")),
    ("complications", ("complication", "cause of death", "causes of death", "stricture", "perforation", "mortality")),
    ("types", ("type", "types", "classify", "classification", "grades", "phases")),
    ("mechanism", ("mechanism", "pathophysiology", "action of", "necrosis", "pathogenesis")),
    ("signs", ("sign", "symptom", "clinical picture", "manifestation", "triad", "smell", "pupil", "urine", "buzzword")),
)
JOINED_WORD_ALLOWLIST = (
    "amphetamine", "amfetamine", "anaesthesia", "anesthesia", "catheter", "chemotherapy", "chlorpromazine", "deferoxamine", "dexamethasone",
    "diethylcarbamazine", "dimercaprol", "erythema", "hyperthermia", "hypothermia", "hypothalamus", "methane", "neostigmine", "noradrenaline",
    "physostigmine", "polyurethane", "pralidoxime", "promethazine", "pyridostigmine", "quadrant", "radiotherapy", "succimer",
)

LOCAL_SOURCES = "relative_path string, name string, role string, years array<int>, preparation_action string, prepared_name string, original_name string, hashes array<string>"
REMOTE_SOURCES = "source_id string, title string, notebook_uuid string, content_hash string, status string"
ANSWERS = "doc_id string, kind string, ordinal int, answer string"
LEDGER_UPDATES = "lecture_key string, seq long, status string, agent_id string, run_id string, artifact_path string, reason string"
CARDS = "id string, category string, badge string, front string, back_bullets array<string>, source_section string, lecture string"
