"""Types, limits, status codes and messages that results must equal."""

PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MSWORD = "application/msword"

MAX_FILE_MB = 10
PROMPT_CHARS = 12_000
MAX_TOKENS = 4096
ANSWER_LIMIT_S = 60
EXTRACTION_TEMPERATURE = 0.1
ANALYSIS_TEMPERATURE = 0.2

CONFIDENCES = ("High", "Medium", "Low")
CAREER_LEVELS = ("Entry", "Junior", "Mid", "Senior", "Lead", "Executive")
PROFICIENCIES = ("Beginner", "Intermediate", "Advanced", "Expert")
ROLE_COUNT = (2, 5)
STRENGTH_COUNT = (2, 5)

SERVICE_MESSAGES = {
    "type": "Unsupported file type '{type}'. Please upload a PDF or DOCX file.",
    "size": "File exceeds maximum size of {mb} MB.",
    "empty": "Uploaded file is empty.",
    "blank_text": "Could not extract any text from the uploaded file.",
    "internal": "An unexpected error occurred while parsing the resume. Please try again.",
}
PARSER_MESSAGES = {"type": "Unsupported file type: {type}. Only PDF and DOCX are supported."}
GATEWAY_MESSAGES = {
    "auth": "Unauthorized",
    "no_file": "No file provided",
    "type": "Unsupported file type. Only PDF and DOCX are accepted.",
    "size": "File exceeds 10 MB limit.",
    "pipeline": "Pipeline exited with an error.",
}
CLIENT_MESSAGES = {
    "type": "Only PDF and DOCX files are supported.",
    "size": "File must be under {mb} MB.",
}

# Words that count as a boolean when a flag arrives as text.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

# Every character that counts as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
