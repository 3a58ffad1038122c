"""Lexical values of the clinical operators; ``settings.py`` holds the thresholds and loads a site's own values."""
from __future__ import annotations

# --- fixed values: the five concept types, their subsets, and the assertion names -------------------------------------
SYMPTOM, LAB_NAME, LAB_RESULT, DIAGNOSIS, DRUG = "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC"
TYPES = [SYMPTOM, LAB_NAME, LAB_RESULT, DIAGNOSIS, DRUG]
ASSERTABLE = [SYMPTOM, DIAGNOSIS, DRUG]
LINKABLE = [DIAGNOSIS, DRUG]
NEGATED, FAMILY, HISTORICAL = "isNegated", "isFamily", "isHistorical"
OTHER = "OTHER"
SECTION_TYPE = {"SYMPTOM": SYMPTOM, "DIAGNOSIS": DIAGNOSIS, "DRUG": DRUG}

# --- fixed values: section headers, in order of precedence, lower case without accents --------------------------------
SECTIONS: dict[str, list[str]] = {
    "SYMPTOM": ["trieu chung hien tai", "cac trieu chung hien tai", "dac diem trieu chung", "dac diem trieu chung khi kham tai khoa cap cuu", "ly do nhap vien", "ly do vao vien", "ly do kham benh", "ly do kham", "thoi diem khoi phat trieu chung", "trieu chung"],
    "DIAGNOSIS": ["chan doan", "cac benh ly man tinh", "cac benh ly mang tinh", "benh ly man tinh", "benh ly mang tinh", "cac benh man tinh", "cac benh mang tinh", "cac benh mac kem"],
    "DRUG": ["thuoc truoc khi nhap vien lan nay", "thuoc truoc khi nhap vien", "thuoc dieu tri", "thuoc dang dung", "dieu tri"],
    "LAB": ["ket qua xet nghiem", "ket qua phong thi nghiem", "ket qua chan doan hinh anh", "ket qua chup anh", "ket qua chup chieu", "cac phat hien chan doan khac", "cac ket qua chan doan khac", "ket qua kham thuc the", "ket qua kham lam sang", "ket qua kham", "xet nghiem"],
    "PROC": ["tien su phau thuat / thu thuat", "tien su phau thuat", "cac thu thuat da thuc hien", "thu thuat da thuc hien"],
    "EVENT": ["cac su kien truoc khi nhap vien", "cac dien bien truoc khi nhap vien", "cac dien bien  truoc khi nhap vien", "dien bien benh", "dien bien", "tinh trang ngay truoc khi nhap vien", "tinh trang luc vao vien", "cac yeu to nguy co lien quan", "cac yeu to nguy co"],
    "HISTORY_PRESENT": ["tien su benh hien tai", "benh su hien tai", "lich su benh hien tai", "tien su benh benh hien tai"],
    "HISTORY_PAST": ["tien su benh noi khoa", "tien su benh ly", "tien su benh noi", "tien su benh", "benh su", "cac tap tuong tu truoc day", "cac dot tuong tu truoc day"],
    "ASSESSMENT": ["danh gia tai benh vien", "kham tai benh vien", "luc vao vien benh vien"],
}

# --- fixed values: context cues, with accents ---------------------------------------------------------------------------
CUES: dict[str, list[str]] = {
    "isNegated": ["không", "không có", "không ghi nhận", "không còn", "không thấy", "phủ nhận", "âm tính", "chưa", "loại trừ"],
    "negation_exceptions": ["không đặc hiệu", "không rõ", "không rõ nguyên nhân"],
    "isFamily": ["gia đình", "tiền sử gia đình", "bố", "mẹ", "cha", "bố mẹ", "cha mẹ", "anh trai", "chị gái", "em trai", "em gái", "người thân", "họ hàng", "di truyền"],
    "isHistorical": ["tiền sử", "tiền căn", "từng bị", "đã từng", "trước đây", "bệnh sử"],
    "historical_section_headers": ["tiền sử", "trước khi nhập viện"],
}

# --- fixed values: abbreviations (normalised) and their full forms ------------------------------------------------------
ABBREVIATIONS: dict[str, str] = {
    "tha": "tăng huyết áp",
    "dtd": "đái tháo đường",
    "dtd type 2": "đái tháo đường type 2",
    "dtd typ 2": "đái tháo đường type 2",
    "nmct": "nhồi máu cơ tim",
    "tbmmn": "tai biến mạch máu não",
    "bptnmt": "bệnh phổi tắc nghẽn mạn tính",
    "copd": "bệnh phổi tắc nghẽn mạn tính",
    "rllpm": "rối loạn lipid máu",
    "xhth": "xuất huyết tiêu hóa",
    "hpq": "hen phế quản",
    "bmv": "bệnh mạch vành",
    "dmv": "bệnh động mạch vành",
    "stm": "suy thận mạn",
    "stc": "suy thận cấp",
    "vgb": "viêm gan b",
    "vgc": "viêm gan c",
    "thk": "thoái hóa khớp",
    "vkdt": "viêm khớp dạng thấp",
    "sdd": "suy dinh dưỡng",
    "nkh": "nhiễm khuẩn huyết",
    "ntdtn": "nhiễm trùng đường tiết niệu",
    "taltmc": "tăng áp lực tĩnh mạch cửa",
    "vrt": "viêm ruột thừa",
    "vpq": "viêm phế quản",
    "sxh": "sốt xuất huyết",
    "gerd": "trào ngược dạ dày thực quản",
}

# --- fixed values: international drug names and the names of the drug vocabulary ----------------------------------------
DRUG_SYNONYMS: dict[str, str] = {
    "paracetamol": "acetaminophen",
    "salbutamol": "albuterol",
    "adrenaline": "epinephrine",
    "noradrenaline": "norepinephrine",
    "frusemide": "furosemide",
    "lignocaine": "lidocaine",
    "lidocaine hydrochloride": "lidocaine",
    "rifampicin": "rifampin",
    "glyceryl trinitrate": "nitroglycerin",
    "trinitrin": "nitroglycerin",
    "co-trimoxazole": "sulfamethoxazole / trimethoprim",
    "cotrimoxazole": "sulfamethoxazole / trimethoprim",
    "amoxicilline": "amoxicillin",
    "ciprofloxacine": "ciprofloxacin",
    "vitamin b1": "thiamine",
    "vitamin b6": "pyridoxine",
    "vitamin b12": "cyanocobalamin",
    "vitamin c": "ascorbic acid",
}

# --- fixed values: phrases that are no concept by themselves ------------------------------------------------------------
FILLERS = ["bệnh", "bệnh nhân", "bệnh lý", "bệnh lí", "bệnh nội khoa", "bệnh hiện tại", "bệnh lý bất thường", "bệnh lý mãn tính", "bệnh lý mạn tính", "tình trạng", "chẩn đoán", "ẩn đoán", "các", "u", "kết quả", "xét nghiệm", "triệu chứng", "điều trị", "hiện tại", "tiền sử", "khám", "theo dõi", "nhập viện"]

# --- fixed values: patterns of the extraction and linking rules ---------------------------------------------------------
DRUG_LEAD_INS = ["đang dùng", "thường dùng", "đã dùng", "tiếp tục dùng", "bắt đầu dùng", "tiếp tục", "bắt đầu", "dùng"]
DRUG_INDICATIONS = ["điều trị", "cho", "dùng cho", "nếu", "khi cần"]
DIAGNOSIS_MODIFIERS = [r"không đặc hiệu", r"không xác định", r"nguyên phát", r"thứ phát", r"nghi ngờ", r"theo dõi", r"chưa rõ nguyên nhân", r"mức độ \w+", r"giai đoạn \w+"]
RRF_TERM_TYPES = ["IN", "PIN", "BN", "SCD", "SBD", "SCDC"]
DOSING_WORDS = ["po", "iv", "im", "sc", "sl", "pr", "bid", "tid", "qid", "qd", "qhs", "qam", "qpm", "prn", "daily", r"q\d+h", r"x\d+", "hs", "ac", "pc", "oral", "suspension", "tablet", "cap", "caps"]
ORAL_WORDS, WEIGHT_UNITS = ["po", "oral", "uống"], ["mg", "mcg", "g"]
