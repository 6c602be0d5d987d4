"""The word lists and patterns that results depend on. Every operator takes its own."""

# Pattern of document numbers on folded upper-case text, and of numbers in file names.
LEGAL_NUMBER = r"(?:^|[^\p{L}\p{N}_])(?:SO\s*[:.]?\s*)?(\d{1,3}\s*(?:/\s*\d{4})?\s*/\s*(?:TT|ND|QD|NQ)\s*-\s*[A-Z-]*[A-Z])"
FILE_NUMBER = r"(?:^|[^0-9])(\d{1,3})[._-](\d{4})[._-](TT|ND|QD|NQ)[._-]([A-Z]+)"
DATE = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
ARTICLE = r"(?iuU)\bđi[eề]u\s+(\d+[a-zđ]?)\s*[.:]?\s*"

# Document types, in order.
TYPES = {
    "Circular": r"\bth[oô]ng\s+t[ưứ]\b|/TT-",
    "Decree": r"\bngh[iị]\s+[đd]ịnh\b|/(?:NĐ|ND)-",
    "Decision": r"\bquy[eế]t\s+[đd]ịnh\b|/(?:QĐ|QD)-",
    "Resolution": r"\bngh[iị]\s+quy[eế]t\b|/NQ-",
    "Law": r"\blu[aậ]t\b",
}

# Predicates of facts. "được" is written whole here, so that it matches.
PREDICATES = {
    "requires": r"(ph[aả]i|c[oó]\s+tr[aá]ch\s+nhi[eệ]m|b[aắ]t\s+bu[oộ]c)",
    "prohibits": r"(kh[oô]ng\s+đ[ưu]ợc|nghi[eê]m\s+c[aấ]m|b[iị]\s+c[aấ]m)",
    "permits": r"(đ[ưu]ợc\s+ph[eé]p|cho\s+ph[eé]p)",
    "has_right": r"(c[oó]\s+quy[eề]n|quy[eề]n\s+đ[ưu]ợc)",
    "amends": r"(s[ưử]a\s+[đd][oổ]i|b[oổ]\s+sung)",
    "replaces": r"(thay\s+th[eế]|h[eế]t\s+hi[eệ]u\s+l[ưự]c)",
}

# Fixed value: words by which a sentence defines a term.
DEFINING = r"(l[aà]|được\s+hiểu\s+là)"

# Hints in questions for the predicate asked for.
INTENTS = {
    "requires": ["phải", "trách nhiệm", "nghĩa vụ", "yêu cầu", "cần làm gì"],
    "prohibits": ["cấm", "không được", "bị cấm"],
    "permits": ["được phép", "cho phép"],
    "has_right": ["quyền", "có quyền"],
    "defines": ["là gì", "định nghĩa", "giải thích từ ngữ"],
    "applies_to": ["áp dụng cho", "đối tượng áp dụng"],
    "amends": ["sửa đổi", "bổ sung"],
    "replaces": ["thay thế", "hết hiệu lực"],
    "references": ["dẫn chiếu", "căn cứ", "liên quan văn bản"],
}

# Expansions of questions, by trigger.
EXPANSIONS = {
    "dữ liệu cá nhân": ["bảo vệ dữ liệu cá nhân", "chủ thể dữ liệu", "xử lý dữ liệu cá nhân"],
    "kiểm soát nội bộ": ["hệ thống kiểm soát nội bộ", "kiểm toán nội bộ", "quản lý rủi ro"],
    "ngân hàng": ["tổ chức tín dụng", "ngân hàng nhà nước", "NHNN"],
    "thanh toán": ["dịch vụ thanh toán", "tài khoản thanh toán", "trung gian thanh toán"],
    "dự phòng rủi ro": ["phân loại tài sản có", "trích lập dự phòng", "xử lý rủi ro"],
}

# Phrases that count double where question and text share them, folded.
FOCUS = ["pham vi dieu chinh", "doi tuong ap dung", "giai thich tu ngu", "nguyen tac", "hieu luc thi hanh", "to chuc thuc hien", "quy dinh chuyen tiep"]

# Phrases taken as entities, and folded keys that are none.
DOMAIN = [
    "bảo vệ dữ liệu cá nhân", "chủ thể dữ liệu", "dữ liệu cá nhân", "dịch vụ thanh toán", "đối tượng áp dụng",
    "dự phòng rủi ro", "hệ thống kiểm soát nội bộ", "kiểm soát nội bộ", "kiểm toán nội bộ", "ngân hàng nhà nước",
    "nguyên tắc", "phạm vi điều chỉnh", "phân loại tài sản có", "quản lý rủi ro", "tài khoản thanh toán",
    "thanh toán không dùng tiền mặt", "tổ chức cung ứng dịch vụ thanh toán", "tổ chức tín dụng", "trích lập dự phòng",
    "trung gian thanh toán", "xử lý dữ liệu cá nhân", "xử lý rủi ro",
]
STOP_KEYS = [
    "ban", "bao", "ben kiem", "bo", "ca nhan", "can cu", "chu", "chinh", "chuong", "co", "cong hoa", "cua", "dang",
    "danh", "dich", "dieu", "dinh", "dinh cua", "dinh tai", "dinh ve", "doc lap", "dong", "duoc", "giay", "hanh phuc",
    "kinh", "lieu", "muc", "ngan", "ngay", "nhan", "quoc", "so", "theo", "the", "thong", "tu do",
]

# Words of questions for an overview, folded, and filler words of such questions.
GLOBAL_HINTS = ["bao quat", "chung", "comprehensive", "global", "khai quat", "overview", "so sanh", "summary", "toan bo", "toan dien", "tom tat", "tong hop", "tong quan"]
FILLERS = ["cac", "chinh", "cua", "diem", "noi", "quy", "quy dinh", "tai lieu", "tom tat", "tong hop", "tong quan", "van ban"]

# The class of capitals (a range of code points, so it holds accented small letters too), and
# patterns of entities: references of law, abbreviations, capitalised phrases.
CAPITALS = "A-ZÀ-ỸĐ"
LEGAL_ENTITY = (
    r"(?iuU)\b(?:Điều\s+\d+[a-z]?|Khoản\s+\d+[a-z]?|Mục\s+\d+[a-z]?|Chương\s+[IVXLC\d]+"
    r"|Nghị\s+định\s+\d+/\d{4}/[A-ZĐ/-]+|Thông\s+tư\s+\d+/\d{4}/[A-ZĐ/-]+|Quyết\s+định\s+\d+/\d{4}/[A-ZĐ/-]+"
    r"|Luật\s+[A-ZÀ-Ỹa-zà-ỹĐđ\s]{3,60})\b"
)
ABBREVIATION = r"(?U)\b[A-ZĐ]{2,}(?:[-/][A-Z0-9Đ]+)*\b"
CAPITALISED = r"(?U)\b[A-ZÀ-ỸĐ][\wÀ-ỹĐđ/-]*(?:\s+(?:[A-ZÀ-ỸĐ0-9][\wÀ-ỹĐđ/-]*|và|của|cho|về|trong|theo|tại)){0,5}"

# The known types of concepts, by group.
ENTITY_TYPES = {
    "LegalDocument": ["Law", "Decree", "Circular", "Decision", "Resolution", "OtherLegalDocument"],
    "LegalSection": ["Chapter", "Section", "Article", "Clause", "Point"],
    "Actor": ["Authority", "FinancialInstitution", "Organization", "Person", "DataRole"],
    "Topic": ["BankingActivity", "Risk", "Control", "Data", "Payment", "Compliance"],
    "Provision": ["Definition", "Requirement", "Prohibition", "Permission", "Right", "Exception"],
}

# Types of concepts that act, and the authorities that issue documents, in order.
ACTORS = ["Authority", "FinancialInstitution", "Organization", "Person", "DataRole"]
ISSUERS = ["state_bank", "government", "ministry_public_security"]

# Misreadings of scans and what they stand for, in order.
OCR_REWRITES = [
    (r"\bdu\s+li[eệ]u\b", "dữ liệu"), (r"\bdu\s+ligu\b", "dữ liệu"), (r"\bdir\s+ligu\b", "dữ liệu"),
    (r"\bdit\s+li[eệ]u\b", "dữ liệu"), (r"\bdit\s+ligu\b", "dữ liệu"), (r"\bd[ữừư]\s+li[eệ]u\b", "dữ liệu"),
    (r"\bd[ée]\s+li[eệ]u\b", "dữ liệu"), (r"\bd[eé]\s+ligu\b", "dữ liệu"), (r"\bch[uủ]\s+th[eé]\b", "chủ thể"),
    (r"\bchi\s+th[eé]\b", "chủ thể"), (r"\bcht\s+th[eé]\b", "chủ thể"), (r"\bx[uử]\s+l[yý]\b", "xử lý"),
    (r"\bxi\s+ly\b", "xử lý"), (r"\bxtr\s+ly\b", "xử lý"), (r"\bki[eé]m\s+so[aá]t\b", "kiểm soát"),
    (r"\bh[oỗ]\s+s[oơ]\b", "hồ sơ"), (r"\bthay\s+doi\b", "thay đổi"), (r"\bs[uử]\s+dung\b", "sử dụng"),
    (r"\bduge\b", "được"), (r"\bdur?gc\b", "được"), (r"\bquy[eé]n\b", "quyền"), (r"\bd[eé]ng\s+y\b", "đồng ý"),
    (r"\bmat\s+d[ữư]\s+li[eệ]u\b", "mất dữ liệu"), (r"\bl[oộ],\s*mat\b", "lộ, mất"),
    (r"\bkh[aả]\s+nang\b", "khả năng"), (r"\bt[oô]\s+ch[uứ]c\b", "tổ chức"),
]
