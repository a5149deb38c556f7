"""Fixed values of the domain.

Everything in this module is content that results depend on (prompt texts,
marker tokens, task names, format strings).  It is data, not logic: changing a
value changes the produced corpora and scores.
"""

# --- fixed values: caption prompts, drawn uniformly -------------------------
CAPTION_PROMPTS = [
    "Describe this image.",
    "Write a caption for this image.",
    "What does this image show?",
    "Generate a caption describing this image.",
    "Provide a description of this image.",
    "What's depicted in this image?",
    "Write a description for this image.",
    "Generate text describing this image.",
    "Create a caption for this image.",
    "What can you see in this image?",
    "Describe what you observe in this image.",
    "Write text explaining this image.",
    "Generate a description of this image.",
    "What is shown in this image?",
    "Provide a caption for this image.",
    "Explain what this image depicts.",
    "Write what you see in this image.",
    "Describe the contents of this image.",
    "Generate text about this image.",
    "What appears in this image?",
]
CAPTION_INSTRUCTION = "Caption the image."

# --- fixed values: system prompts ------------------------------------------
TRAIN_SYSTEM_PROMPT = "You are a powerful visual assistant. "
DIALOG_SYSTEM_PROMPT = "You are a powerful visual assistant."
VQA_SYSTEM_PROMPT = "You are a useful Visual Assitant"
AUGMENT_SYSTEM_PROMPT = "You are a helpful assistant for data aguementation."
AUGMENT_PROMPT = (
    "Here's a question and the answer to that question. Please extend the answer "
    "so that it is a complete response suitable for a chatbot. Please just respond "
    "with the augmented answer ONLY!"
)

# --- fixed values: request template ----------------------------------------
REQUEST_METHOD = "POST"
REQUEST_URL = "/v1/chat/completions"
REQUEST_MODEL = "gpt-4o-mini"
REQUEST_MAX_TOKENS = 128
REQUEST_BATCH_SIZE = 50_000

# --- reply to a request with a broken image ---------------------------------
SERVE_IMAGE_ERROR = "The image cannot be decoded."

# --- fixed values: interactive requests ------------------------------------
SERVE_SUFFIX = "Carefully explain your reasoning before answering the question."
SERVE_DEFAULT_PROMPT = "<IMGPLH>Describe this image."
REASONING_SUFFIX = "Carefully exlain your reasoning beofer answering the question."

# --- fixed values: tags of a question-answer training text ------------------
VQA_TAGS = {"system": ("<sys>", "</sys>"), "user": ("<user>", "</user>"), "assistant": ("<assist>", "</assist>")}
VQA_OPEN_ANSWER = "It's "

# --- fixed values: metric tags ----------------------------------------------
TRAINING_METRICS = ["loss", "grad_norm", "learning_rate"]
TAG_TRAINING = "training/"
TAG_OTHER = "other/"
TAG_EVALUATION = "evaluation/"
EVAL_PREFIX = "eval_"

# --- fixed values: image markers -------------------------------------------
PLACEHOLDER = "<IMGPLH>"
DUMP_PLACEHOLDER = "<image>"
IMAGE_START = "<Image>"
IMAGE_END = "<Image_End>"
INFERENCE_IMAGE_START = "<IMAGE>"
INFERENCE_IMAGE_END = "<IMAGE_END>"
CAPTION_TOKEN = "<Caption>"
IMAGE_TOKEN = "<Image_Token>"
NUM_IMAGE_TOKENS = 64
# (type, token) in the order in which ids are appended to the base vocabulary
ADDED_TOKENS = [
    ("Image", IMAGE_START),
    ("Image_End", IMAGE_END),
    ("Caption", CAPTION_TOKEN),
    ("Image_Token", IMAGE_TOKEN),
]

# --- fixed values: chat format ---------------------------------------------
BOS = "<|begin_of_text|>"
HEADER_OPEN = "<|start_header_id|>"
HEADER_CLOSE = "<|end_header_id|>\n\n"
END_OF_TURN = "<|eot_id|>"
SYSTEM_PREAMBLE = "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"
# the template leaves one line break inside the assistant span, see README
GENERATION_BREAK = "\n"
REPLY_MARKER = "assistant\n\n"
CHAT_SPECIALS = [BOS, HEADER_OPEN, "<|end_header_id|>", END_OF_TURN]

# size of the base vocabulary that added tokens follow
BASE_VOCAB_SIZE = 128_256
IGNORE_LABEL = -100

# --- fixed values: evaluation tasks ----------------------------------------
TASK_TYPES = {
    "Perception": [
        "existence", "count", "position", "color", "posters",
        "celebrity", "scene", "landmark", "artwork", "OCR",
    ],
    "Cognition": [
        "commonsense_reasoning", "numerical_calculation",
        "text_translation", "code_reasoning",
    ],
}

# --- fixed values: instruction corpus subsets, in load order ----------------
INSTRUCTION_SUBSETS = [
    "coco", "textcap", "image-paragraph-captioning", "coco-goi",
    "coco-text", "imagenet", "coco-itm", "snli-ve", "mocheg",
    "iqa", "vqa-v2", "shapes", "docvqa", "ocr-vqa", "st-vqa",
    "text-vqa", "gqa", "okvqa", "a-okvqa", "science-qa",
    "viquae", "clevr", "nlvr", "vcr", "visual-mrc",
    "winoground", "vist", "visual-dialog", "multi30k",
]

# --- fixed values: image processing and fetch defaults ----------------------
IMAGE_SIZE = 448
CROP_THRESHOLD = 0.6
FETCH_TIMEOUT_SECONDS = 5
FETCH_THREADS = 128
CHUNK_ROWS = 100_000

# (label, substring) in match order; a message matching none is "Other"
ERROR_CLASSES = [
    ("Timeout", "timeout"),
    ("Connection Error", "connection"),
    ("Not Found (404)", "404"),
    ("SSL Error", "ssl"),
    ("Memory Error", "memory"),
]

# --- fixed values: text report, (format, report column) ---------------------
REPORT_TITLE = "Download Report"
REPORT_RULE = "=" * 50
REPORT_LINES = [
    ("Total images processed: %d", "total_images"),
    ("Successfully downloaded: %d", "downloaded"),
    ("Failed downloads: %d", "failed"),
    ("Success rate: %.2f%%", "success_rate"),
    ("Average download time per image: %.2f seconds", "average_seconds"),
    ("Total processing time: %.2f seconds", "total_seconds"),
    ("Processing speed: %.2f images/second", "images_per_second"),
    ("Theoretical max speed: %.2f images/second", "theoretical_images_per_second"),
    ("Images center cropped: %d", "center_cropped"),
    ("Images padded with black: %d", "padded"),
]
REPORT_ERRORS_TITLE = "Common error types:"
REPORT_ERROR_LINE = "  - %s: %d"

# whitespace removed by a Python-style strip
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
