"""Queries over forms. Their texts are written from columns of orders and customers, so the SQL knows every field's value from the columns."""

from pyspark.sql import functions as F

from quirefold.operators import forms, templates
from quirefold.plans.registry import query, table, wide

KINDS = ["LEAVE_REQUEST", "EMPLOYMENT_CONTRACT", "HR_DECISION", "EMPLOYEE_INFORMATION_FORM"]
FAMILIES = ["CV", "ADMINISTRATIVE_REQUEST", "CONTRACT_DECISION", "DEGREE_CERTIFICATE", "EMPLOYEE_FORM_TABLE"]


def customers(spark, sf_dir):
    o = wide(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("k"), F.replace("c_name", F.lit("#000"), F.lit(" C")).alias("name"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "d/M/yyyy").alias("day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("full_day"),
        F.when(k % 5 == 0, "12").otherwise(F.concat(F.lit("NVA"), k.cast("string"))).alias("staff"), F.when(k % 2 == 0, "ocr").otherwise("docx_text").alias("kind"), F.when(k % 3 == 0, 0.9).otherwise(0.97).alias("confidence"),
    )


CUSTOMERS = """c AS (SELECT o_orderkey AS k, replace(c_name, '#000', ' C') AS name, c_mktsegment AS segment, o_orderpriority AS priority, strftime(o_orderdate, '%-d/%-m/%Y') AS day, strftime(o_orderdate, '%d/%m/%Y') AS full_day, CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE 'NVA' || o_orderkey END AS staff,
 CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'docx_text' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.97 END AS confidence, o_orderkey % 5 <> 0 AS staff_ok FROM orders JOIN customer ON o_custkey = c_custkey)"""
GRADED = "CASE WHEN value IS NULL THEN 'not_found' WHEN valid AND (kind <> 'ocr' OR confidence >= 0.94) THEN 'accepted' ELSE 'needs_review' END AS status"


def text(*parts):
    """Columns by their names, other strings as they are, in one text."""
    return F.concat(*(p if not isinstance(p, str) else F.col(p) if p in COLUMNS else F.lit(p) for p in parts))


COLUMNS = {"name", "segment", "priority", "day", "full_day", "staff"}


def blocks(*lines):
    return F.transform(F.array(*lines), lambda t: F.struct(t.alias("text"), F.col("kind").alias("kind"), F.col("confidence").alias("confidence")))


def hr_forms(spark, sf_dir):
    """One of four forms an order."""
    k = F.col("k").cast("string")
    by = [
        blocks(text("ĐƠN XIN NGHỈ PHÉP"), text("Họ và tên: ", "name"), text("Mã NV: ", "staff"), text("Bộ phận"), text("segment"), text("Thời gian nghỉ: Từ ", "day", " đến ", "full_day"), text("Số ngày nghỉ: ", (F.col("k") % 4).cast("string"), " ngày"), text("Lý do: ", "priority")),
        blocks(text("Số hợp đồng: HD/", k), text("Người lao động - ", "name"), text("Mã nhân viên: ", "staff"), text("Chức danh: Kỹ sư"), text("MỨC LƯƠNG: 12.000.000"), text("Ngày hiệu lực: ", "day")),
        blocks(text("Số: QD-", k), text("Về việc: bổ nhiệm nhân sự"), text("Điều 1. Bổ nhiệm Ông/Bà ", "name", ", mã nhân viên ", "staff"), text("Chức danh: Trưởng nhóm, hiệu lực từ ngày ", "day")),
        blocks(text("PHIẾU THÔNG TIN NHÂN VIÊN"), text("Họ tên: ", "name"), text("Mã nhân viên: ", "staff"), text("Ngày sinh / Giới tính: ", "day", " / Nữ"), text("Phòng ban: ", "segment"), text("Email: nv", k, "@congty.vn"), text("Điện thoại:"), text("Số 5"), text("Địa chỉ liên hệ: ", "priority")),
    ]
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 4).cast("int") + 1)
    rows = customers(spark, sf_dir)
    out = by[3]
    for i in (2, 1, 0):
        out = F.when(F.col("k") % 4 == i, by[i]).otherwise(out)
    return rows.select("k", kind.alias("document_type"), out.alias("blocks"))


HR_FIELDS = f"""{CUSTOMERS}, f AS (
SELECT k, 'LEAVE_REQUEST' AS document_type, kind, confidence, unnest(['employeeName', 'employeeId', 'department', 'leaveStartDate', 'leaveEndDate', 'leaveDays', 'leaveReason']) AS field, unnest([name, staff, segment, day, full_day, (k % 4) || ' ngày', priority]) AS value,
  unnest([name, staff, segment, full_day, full_day, (k % 4)::VARCHAR, priority]) AS normalized, unnest([true, staff_ok, true, true, true, k % 4 > 0, true]) AS valid FROM c WHERE k % 4 = 0
UNION ALL SELECT k, 'EMPLOYMENT_CONTRACT', kind, confidence, unnest(['contractNumber', 'employeeName', 'employeeId', 'jobTitle', 'salary', 'startDate']), unnest(['HD/' || k, name, staff, 'Kỹ sư', '12.000.000', day]), unnest(['HD/' || k, name, staff, 'Kỹ sư', '12.000.000', full_day]), unnest([true, true, staff_ok, true, true, true]) FROM c WHERE k % 4 = 1
UNION ALL SELECT k, 'HR_DECISION', kind, confidence, unnest(['decisionNumber', 'employeeName', 'employeeId', 'action', 'newJobTitle', 'effectiveDate']), unnest(['QD-' || k, name, staff, 'bổ nhiệm', 'Trưởng nhóm', day]), unnest(['QD-' || k, name, staff, 'Bổ nhiệm', 'Trưởng nhóm', full_day]), unnest([true, true, staff_ok, true, true, true]) FROM c WHERE k % 4 = 2
UNION ALL SELECT k, 'EMPLOYEE_INFORMATION_FORM', kind, confidence, unnest(['employeeName', 'employeeId', 'dateOfBirth', 'gender', 'department', 'email', 'phoneNumber', 'address']), unnest([name, staff, day, 'Nữ', segment, 'nv' || k || '@congty.vn', 'Số 5', priority]), unnest([name, staff, full_day, 'Nữ', segment, 'nv' || k || '@congty.vn', 'Số 5', priority]), unnest([true, staff_ok, true, true, true, true, false, true]) FROM c WHERE k % 4 = 3),
g AS (SELECT *, {GRADED} FROM f)"""


def each(rows, *keys):
    """A row a field. The outer explode keeps Spark from computing all fields once more in a filter on their number."""
    return rows.select(*keys, F.explode_outer("fields").alias("f")).where("f IS NOT NULL")


def listed(rows):
    return each(rows, "k", "document_type").select("k", "document_type", F.col("f.name").alias("field"), "f.value", "f.normalized", "f.status")


@query(f"WITH {HR_FIELDS} SELECT k, document_type, field, value, normalized, status FROM g")
def form_fields(spark, sf_dir):
    return listed(forms.read_forms(hr_forms(spark, sf_dir)))


def family_texts(spark, sf_dir):
    """One document of a family an order."""
    k = F.col("k").cast("string")
    emp = F.concat(F.lit("EMP.10"), k)
    by = [
        blocks(text("CURRICULUM VITAE"), text("Nguyễn Văn AnKỹ sư phần mềm"), text("Vị trí ứng tuyển: ", "segment"), text("mail an", k, "@b.vn, tel 0912 345 678"), text("Học vấn"), text("Đại học ", "priority"), text("Kinh nghiệm làm việc"), text("Công ty ", "name"), text("Sản phẩm ", k), text("Kỹ năng"), text("SQL")),
        blocks(text("Giấy đề nghị công tác"), text("Số phiếu: P", k), text("Người đề nghị: ", "name"), text("MSNV: ", "staff"), text("Phòng ban: ", "segment"), text("Mục đích: ", "priority"), text("Ngày đi: ", "day"), text("Khởi hành, đến ngày: ", "full_day")),
        blocks(text("Số: 12/QD-", k), text("Họ và tên: ", "name", " | Mã nhân viên: ", emp), text("Chức danh: Kỹ sư  Mức lương: 15 triệu"), text("Từ ngày: ", "day"), text("Đến ngày"), text("full_day"), text("Quyết định có hiệu lực từ ngày ", "full_day")),
        blocks(text("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), text("Trường ", "segment"), text("BẰNG CỬ NHÂN"), text("Trân trọng chứng nhận"), text("Trần Thị Bình"), text("Ngành: Toán | Xếp loại: Giỏi"), text("Ngày cấp"), text("day"), text("Số hiệu văn bằng: VB", k)),
        blocks(text("Phiếu thông tin nhân viên"), text("Số phiếu - F", k), text("Họ tên: ", "name"), text("Mã NV: ", "staff"), text("Ngày sinh: ", "day"), text("Giới tính: Nam"), text("Bộ phận: ", "segment"), text("Công ty: ", "priority"), text("Ngày nhận việc: ", "full_day")),
    ]
    out = by[4]
    for i in (3, 2, 1, 0):
        out = F.when(F.col("k") % 5 == i, by[i]).otherwise(out)
    kind = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("k") % 5).cast("int") + 1)
    return customers(spark, sf_dir).select("k", kind.alias("document_type"), out.alias("blocks"))


FAMILY_FIELDS = f"""{CUSTOMERS}, f AS (
SELECT k, 'CV' AS document_type, kind, confidence, unnest(['fullName', 'headline', 'email', 'phoneNumber', 'address', 'education', 'experience', 'skills']) AS field, unnest(['Nguyễn Văn An', segment, 'an' || k || '@b.vn', '0912 345 678', NULL, 'Đại học ' || priority, 'Công ty ' || name || chr(10) || 'Sản phẩm ' || k, 'SQL']) AS value, true AS valid FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'ADMINISTRATIVE_REQUEST', kind, confidence, unnest(['documentTitle', 'requestNumber', 'employeeName', 'employeeId', 'department', 'jobTitle', 'reason', 'startDate', 'endDate']), unnest(['Giấy đề nghị công tác', 'phiếu: P' || k, name, staff, segment, NULL, priority, day, full_day]), true FROM c WHERE k % 5 = 1
UNION ALL SELECT k, 'CONTRACT_DECISION', kind, confidence, unnest(['documentNumber', 'employeeName', 'employeeId', 'jobTitle', 'action', 'salary', 'startDate', 'endDate', 'effectiveDate']), unnest(['12/QD-' || k, name, 'EMP.10' || k, 'Kỹ sư', NULL, NULL, day, full_day, full_day]), true FROM c WHERE k % 5 = 2
UNION ALL SELECT k, 'DEGREE_CERTIFICATE', kind, confidence, unnest(['recipientName', 'credentialType', 'credentialId', 'issuingOrganization', 'fieldOfStudy', 'degreeLevel', 'classification', 'issueDate']), unnest(['Trần Thị Bình', 'BẰNG CỬ NHÂN', 'VB' || k, 'Trường ' || segment, 'Toán', NULL, 'Giỏi', day]), true FROM c WHERE k % 5 = 3
UNION ALL SELECT k, 'EMPLOYEE_FORM_TABLE', kind, confidence, unnest(['formNumber', 'employeeName', 'employeeId', 'dateOfBirth', 'gender', 'department', 'jobTitle', 'email', 'phoneNumber', 'address', 'organization', 'joinDate']), unnest(['F' || k, name, staff, day, 'Nam', segment, NULL, NULL, NULL, NULL, priority, full_day]), true FROM c WHERE k % 5 = 4),
g AS (SELECT *, {GRADED} FROM f),
s AS (SELECT * REPLACE (CASE WHEN status = 'accepted' AND kind = 'ocr' AND field IN ({', '.join(f"'{n}'" for n in forms.SENSITIVE)}) THEN 'needs_review' ELSE status END AS status) FROM g)"""


@query(f"WITH {FAMILY_FIELDS} SELECT k, document_type, field, value, CASE WHEN field = 'employeeId' AND document_type = 'CONTRACT_DECISION' THEN replace(value, '.', '-') ELSE value END AS normalized, status FROM s")
def family_fields(spark, sf_dir):
    rows = forms.read_forms(family_texts(spark, sf_dir), forms.FAMILY_FORMS)
    return listed(rows.withColumn("fields", forms.guarded(F.col("fields"))))


@query(
    f"""WITH {FAMILY_FIELDS} SELECT k, document_type, count(*)::INT AS expected, count(value)::INT AS present, count(*) FILTER (status = 'accepted')::INT AS accepted, count(*) FILTER (status = 'needs_review')::INT AS needs_review, count(*) FILTER (status = 'not_found')::INT AS not_found,
 round_even(count(value) / count(*)::DOUBLE, 6) AS completeness, round_even(count(*) FILTER (status = 'accepted') / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER (status = 'accepted') = count(*) AS ready FROM s GROUP BY ALL"""
)
def sanitized_summary(spark, sf_dir):
    rows = forms.read_forms(family_texts(spark, sf_dir), forms.FAMILY_FORMS)
    return forms.sanitized(rows.withColumn("fields", forms.guarded(F.col("fields"))), "k")


@query(f"WITH {HR_FIELDS} SELECT k, array_to_string(list(field ORDER BY field), ',') AS broken FROM (SELECT *, CASE WHEN k % 7 = 0 THEN 'accepted' ELSE status END AS s2, CASE WHEN k % 11 = 0 THEN NULL ELSE kind END AS k2 FROM g) WHERE (s2 = 'accepted' AND (NOT valid OR value IS NULL)) OR (value IS NOT NULL AND k2 IS NULL) GROUP BY k")
def field_invariants(spark, sf_dir):
    rows = forms.read_forms(hr_forms(spark, sf_dir))
    spoilt = F.transform("fields", lambda f: f.withField("status", F.when(F.col("k") % 7 == 0, "accepted").otherwise(f["status"])).withField("kind", F.when(F.col("k") % 11 != 0, f["kind"])))
    return rows.select("k", F.array_join(F.array_sort(forms.broken_promises(spoilt)), ",").alias("broken")).where("broken <> ''")


@query("SELECT event_id, array_to_string(list_sort(list_transform(list_filter(json_keys(props), lambda n: n <> 'w' AND json_type(props, '$.' || n) NOT IN ('OBJECT', 'ARRAY', 'NULL')), lambda n: n || '=' || json_extract_string(props, '$.' || n))), ',') AS fields FROM events")
def scalar_fields(spark, sf_dir):
    pairs = F.transform(F.map_entries(forms.scalars(F.col("props"), ["w"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(pairs), ",").alias("fields"))


LEAVE = """'Kính gửi: - Ban Giám đốc ' || segment || chr(10) || 'Tôi tên là: ' || name || chr(10) || 'Chức vụ: Kỹ sư' || chr(10) || 'Bộ phận: ' || segment || chr(10) || CASE WHEN k % 6 = 0 THEN 'Chức vụ: Khác' || chr(10) ELSE '' END || 'Điện thoại: 09' || k || chr(10) || 'Tôi xin nghỉ trong thời gian ' || k % 9 || ',5 ngày' || chr(10) || 'kể từ ngày ' || day || ' đến hết ngày ' || full_day || '.' || chr(10) || 'Lý do xin nghỉ phép: việc ' || k || '.' || chr(10) || 'Tôi dự kiến trở lại làm việc vào ngày ' || day || chr(10) || 'Tôi đã bàn giao công việc cho: ' || name || ' - Bộ phận: ' || priority || '.' || chr(10) || 'Ngày 5 tháng 2 năm 2024'"""
LEAVE_FIELDS = ["organization", "employeeName", "jobTitle", "department", "phone", "leaveDays", "startDate", "endDate", "reason", "expectedReturnDate", "handoverTo", "handoverDepartment", "requestDate"]


def picked(rows, names):
    return rows.select("k", *(F.element_at("r.fields", n).alias(n) for n in names), F.array_join("r.conflicts", ",").alias("conflicts"))


@query(
    f"""WITH {CUSTOMERS}, d AS (SELECT *, strftime(strptime(full_day, '%d/%m/%Y'), '%Y-%m-%d') AS iso FROM c)
SELECT k, segment AS organization, name AS "employeeName", CASE WHEN k % 6 <> 0 THEN 'Kỹ sư' END AS "jobTitle", segment AS department, '09' || k AS phone, (k % 9) || '.5' AS "leaveDays", iso AS "startDate", iso AS "endDate", 'việc ' || k AS reason, iso AS "expectedReturnDate", name AS "handoverTo", priority AS "handoverDepartment", '2024-02-05' AS "requestDate", CASE WHEN k % 6 = 0 THEN 'jobTitle' ELSE '' END AS conflicts FROM d"""
)
def leave_form(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("text", F.expr(LEAVE.replace("chr(10)", "char(10)")))
    return picked(rows.withColumn("r", templates.leave_request(F.col("text"))), LEAVE_FIELDS)


OVERTIME = """'Kính gửi: Ban Giám đốc ' || segment || '.' || chr(10) || 'Tôi là: ' || name || ' - Chức vụ: Kỹ sư' || chr(10) || 'Hợp đồng lao động số HD' || k || ' ký ngày ' || day || ', thời gian làm việc 8h-17h. Do dự án ' || k || ', tôi đề nghị tăng ca.' || chr(10) || CASE WHEN k % 2 = 0 THEN 'Thời gian đề nghị: Từ ngày ' || day || ' đến hết ngày ' || full_day || ', tăng thêm 2,5 giờ mỗi ngày, từ 18 giờ 30 phút đến 21 giờ' ELSE 'Thời gian đề nghị: Ngày ' || day || ', làm thêm 3 giờ, từ 18 giờ đến 21 giờ' END || chr(10) || 'với tổng thời gian dự kiến là ' || k % 50 || ' giờ.' || chr(10) || 'Nội dung công việc: kiểm thử ' || k || '. Tôi cam kết.'"""
OVERTIME_FIELDS = ["organization", "employeeName", "jobTitle", "laborContractNumber", "laborContractDate", "standardWorkSchedule", "reason", "startDate", "endDate", "overtimeHoursPerDay", "overtimeStartTime", "overtimeEndTime", "totalOvertimeHours", "workContent"]


@query(
    f"""WITH {CUSTOMERS}, d AS (SELECT *, strftime(strptime(full_day, '%d/%m/%Y'), '%Y-%m-%d') AS iso FROM c)
SELECT k, segment AS organization, name AS "employeeName", 'Kỹ sư' AS "jobTitle", 'HD' || k AS "laborContractNumber", iso AS "laborContractDate", '8h-17h' AS "standardWorkSchedule", 'dự án ' || k AS reason, iso AS "startDate", iso AS "endDate", CASE WHEN k % 2 = 0 THEN '2.5' ELSE '3' END AS "overtimeHoursPerDay",
 CASE WHEN k % 2 = 0 THEN '18:30' ELSE '18:00' END AS "overtimeStartTime", '21:00' AS "overtimeEndTime", (k % 50)::VARCHAR AS "totalOvertimeHours", 'kiểm thử ' || k AS "workContent", '' AS conflicts FROM d"""
)
def overtime_form(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("text", F.expr(OVERTIME.replace("chr(10)", "char(10)")))
    return picked(rows.withColumn("r", templates.overtime_request(F.col("text"))), OVERTIME_FIELDS)


def one_form(spark, sf_dir, rules, *lines):
    rows = customers(spark, sf_dir).withColumn("document_type", F.lit("X")).withColumn("blocks", blocks(*lines))
    return each(forms.read_forms(rows, {"X": rules}), "k").select("k", F.col("f.name").alias("field"), F.col("f.normalized").alias("value"))


def spread(pairs):
    return f"SELECT k, unnest([{', '.join(repr(n) for n, _ in pairs)}]) AS field, unnest([{', '.join(v for _, v in pairs)}]) AS value"


@query(
    f"""WITH {CUSTOMERS} {spread([
        ('contract_number', "'12/' || k"), ('contract_sign_date', 'full_day'), ('effective_date', 'full_day'), ('probation_end_date', 'full_day'), ('employer_name', 'segment'), ('employer_representative', "'Trần Văn Bình'"), ('employee_name', 'name'), ('employee_id_number', "'012345678901'"), ('professional_title', "'Kỹ sư dữ liệu'"),
        ('role_title', "'Trưởng nhóm'"), ('workplace', "'tòa nhà ' || priority || ' phường 5'"), ('weekly_hours', "'40 giờ/tuần'"), ('probation_salary_monthly', "'12.000.000 đồng/tháng'"), ('allowances_summary', "'ăn trưa'"), ('salary_payment_schedule', "'chuyển khoản'"),
    ])} FROM c"""
)
def contract_form(spark, sf_dir):
    k = F.col("k").cast("string")
    return one_form(
        spark, sf_dir, templates.CONTRACT,
        text("HỢP ĐỒNG THỬ VIỆC"), text("1. Số hợp đồng: 12/", k, " | Ngày ký: 1/1/1999"), text("Hôm nay, ngày ", "day"), text("Tên công ty: ", "segment"), text("Bên A"), text("Đại diện bởi: Ông Trần Văn Bình Chức vụ: Giám đốc"),
        text("Bên B"), text("Họ và tên: ", "name", " Giới tính: Nam"), text("CCCD số: 0123 4567 8901"), text("Chức vụ: Trưởng nhóm; kiêm nhiệm"), text("Điều 1"), text("Thử việc kể từ"), text("từ ngày ", "day", " đến hết ngày ", "full_day"),
        text("Chức danh công việc: Kỹ sư dữ liệu."), text("Địa điểm làm việc: tòa nhà ", "priority"), text("phường 5."), text("Thời giờ làm việc: 8h00 - 12h00, 13h30 - 17h30"), text("Mức lương thử việc: 12.000.000 đồng/tháng"), text("Phụ cấp: ăn trưa."), text("Hình thức trả lương: chuyển khoản"),
    )


@query(
    f"""WITH {CUSTOMERS} {spread([
        ('full_name', "'Nguyễn Văn An'"), ('headline', "'Kỹ sư phần mềm'"), ('email', "'an' || k || '@b.vn'"), ('phone_number', "'0912 345 678'"), ('address', 'segment'), ('desired_role', "'kiến trúc sư'"), ('years_experience', "'hơn ' || k % 9 || ' năm'"), ('experience', "'Công ty ' || priority || ': hơn ' || k % 9 || ' năm'"),
        ('skills', "'SQL, Spark' || chr(10) || 'Python'"), ('education', "'Đại học'"),
    ])} FROM c"""
)
def cv_form(spark, sf_dir):
    k = F.col("k")
    return one_form(
        spark, sf_dir, templates.CV,
        text("Nguyễn Văn AnKỹ sư phần mềm"), text("an", k.cast("string"), "@b.vn, 0912 345 678"), text("Địa chỉ: ", "segment"), text("Mục tiêu nghề nghiệp"), text("Sớm trở thành kiến trúc sư trong ba năm tới"), text("Kinh nghiệm làm việc"), text("Công ty ", "priority", ": hơn ", (k % 9).cast("string"), " năm"),
        text("Kỹ năng"), text("• Dữ liệu: SQL, Spark"), text("- Python"), text("Học vấn"), text("Đại học"),
    )


CARD = """'CĂN CƯỚC CÔNG DÂN' || chr(10) || 'Số / No: ' || lpad(k, 12, '0') || chr(10) || 'Họ và tên / Full name' || chr(10) || '..' || chr(10) || 'TRẦN THỊ BÌNH' || chr(10) || 'Ngày sinh / Date of birth: ' || full_day || chr(10) || 'Giới tính: Nữ' || chr(10) || 'Quốc tịch: Việt Nam' || chr(10) || 'Quê quán' || chr(10) || 'Xã ' || segment || chr(10) || 'Nơi thường trú: Phường ' || priority"""


@query(f"WITH {CUSTOMERS} SELECT k, lpad(k::VARCHAR, 12, '0') AS \"idNumber\", 'TRẦN THỊ BÌNH' AS \"fullName\", full_day AS \"dateOfBirth\", 'Nữ' AS sex, 'Việt Nam' AS nationality, 'Xã ' || segment AS \"placeOfOrigin\", 'Phường ' || priority AS \"placeOfResidence\" FROM c")
def card_form(spark, sf_dir):
    rows = customers(spark, sf_dir).withColumn("m", templates.identity_card(F.expr(CARD.replace("chr(10)", "char(10)"))))
    return rows.select("k", *(F.element_at("m", n).alias(n) for n in ("idNumber", "fullName", "dateOfBirth", "sex", "nationality", "placeOfOrigin", "placeOfResidence")))


@query(
    f"""WITH {CUSTOMERS}, d AS (SELECT k, lpad((k % 1000000)::VARCHAR, 6, '0') AS cand, (k % 9) || '.5' AS band, full_day FROM c)
SELECT k, 'NGUYEN VAN AN' AS recipient, cand AS candidate, '24VN' || cand || 'NGUV001A' AS form_number, 'ACADEMIC' AS type, band AS overall, full_day AS date FROM d"""
)
def score_form(spark, sf_dir):
    k = F.col("k")
    cand = F.lpad((k % 1000000).cast("string"), 6, "0")
    lines = [text("Test Report Form ACADEMIC"), text("Candidate Number"), cand, text("Date ", "full_day"), text("Family Name: NGUYEN"), text("First Name(s)"), text("VAN AN"), F.concat(F.lit("Overall Band Score "), (k % 9).cast("string"), F.lit(".5")), text("Form Number"), F.concat(F.lit("24VN"), F.translate(cand, "0", "O"), F.lit("NGUVOO1A"))]
    bs = F.transform(F.array(*lines), lambda t, i: F.struct(t.alias("text"), (i * 10).cast("double").alias("y")))
    rows = customers(spark, sf_dir).withColumn("s", templates.score_report(bs))
    return rows.select("k", "s.recipient", "s.candidate", "s.form_number", "s.type", "s.overall", "s.date")


LABELS = {"full_name": ("full name", "họ và tên"), "segment": ("phân khúc", "segment"), "none": ("không có",)}


@query(
    f"""WITH {CUSTOMERS} SELECT k, name AS full_name, segment, 'full_name' AS present, 'REVIEW_FIRST_REQUIRED' || CASE WHEN k % 2 = 0 THEN ',TEMPLATE_ANCHOR_PARTIAL' ELSE '' END AS errors, 'none' AS missing, least(0.8, (k % 10) / 10.0::DOUBLE) AS confidence, 'MANUAL_REVIEW' AS action FROM c"""
)
def review_form(spark, sf_dir):
    k = F.col("k")
    rows = customers(spark, sf_dir).withColumn("m", templates.review_only(text("HỌ VÀ TÊN: ", "name", "\nPhân khúc\n", "segment", ".\nXong"), LABELS))
    none = F.filter(F.array(F.lit("")), lambda _: F.lit(False))
    rows = rows.withColumn("v", templates.manual_only(F.col("m"), ["segment", "none"], (k % 10) / F.lit(10.0), none, k % 2 != 0))
    return rows.select("k", F.element_at("m", "full_name").alias("full_name"), F.element_at("m", "segment").alias("segment"), F.lit("full_name").alias("present"), F.array_join("v.errors", ",").alias("errors"), F.array_join("v.missing", ",").alias("missing"), "v.confidence", "v.action")


#: Requests as a recognizer reads them: marks lost, labels broken, or no phrase left and only the dates in their order.
SCANNED_LEAVE = """CASE k % 4 WHEN 0 THEN 'Tôi tên là: ' || name || chr(10) || 'Chức vụ: Kỹ sư' || chr(10) || 'Bộ phận: ' || segment || chr(10) || 'Tôi xin nghỉ trong thời gian ' || k % 9 || ',5 ngày kể từ ngày ' || day || ' đến hết ngày ' || full_day || '.'
 WHEN 1 THEN 'Tôi tên là ' || name || chr(10) || 'Chuc vu Kỹ sư' || chr(10) || 'Bo phân: ' || segment || chr(10) || 'xin nghi trong thoi gian ' || k % 9 || ' ngày tu ' || day || ' den ' || full_day || chr(10) || 'Lý do xin nghi phép: việc ' || k || '. Tôi d kiên tro lai ngày 05/12/2030'
 WHEN 2 THEN 'Tôi tên là ' || name || chr(10) || 'Ch|c v|: Kỹ sư.' || chr(10) || 'nghi ' || k % 9 || ' ng: ' || day || ', ' || full_day || ', 05/12/2030' || chr(10) || 'Lý do xin nghỉ phép: việc ' || k
 ELSE 'Toi ten la ' || name || chr(10) || day END"""
LEAVE_SCANNED = ["employeeName", "jobTitle", "department", "leaveDays", "startDate", "endDate", "reason", "expectedReturnDate", "approverName"]


@query(
    f"""WITH {CUSTOMERS}, d AS (SELECT *, strftime(strptime(full_day, '%d/%m/%Y'), '%Y-%m-%d') AS iso FROM c)
SELECT k, CASE WHEN k % 4 < 3 THEN name END AS "employeeName", CASE WHEN k % 4 < 3 THEN 'Kỹ sư' END AS "jobTitle", CASE WHEN k % 4 < 2 THEN segment END AS department, CASE k % 4 WHEN 0 THEN (k % 9) || '.5' WHEN 1 THEN (k % 9)::VARCHAR END AS "leaveDays", CASE WHEN k % 4 < 3 THEN iso END AS "startDate", CASE WHEN k % 4 < 3 THEN iso END AS "endDate",
 CASE WHEN k % 4 IN (1, 2) THEN 'việc ' || k END AS reason, CASE WHEN k % 4 IN (1, 2) THEN '2030-12-05' END AS "expectedReturnDate", CASE WHEN k % 3 = 0 THEN name END AS "approverName", '' AS conflicts FROM d"""
)
def scanned_leave(spark, sf_dir):
    """Four readings of leave requests, with the approver's table: named, only signed, or without its heading."""
    rows = customers(spark, sf_dir).withColumn("text", F.expr(SCANNED_LEAVE.replace("chr(10)", "char(10)")))
    cells = lambda *xs: F.array(*(F.array(x) for x in xs))
    k, head = F.col("k"), F.lit("TRƯỞNG BỘ PHẬN")
    tables = F.array(cells(F.lit("Ghi chú"), F.lit("x")), F.when(k % 3 == 0, cells(head, F.lit("(Ký)"), F.concat("name", F.lit(".")))).when(k % 3 == 1, cells(head, F.lit("x"), F.lit("(Ký, ghi rõ họ tên)"))).otherwise(cells(F.lit("GIÁM ĐỐC"), F.lit("x"), F.col("name"))))
    return picked(rows.withColumn("r", templates.leave_request(F.col("text"), F.lit(True), tables)), LEAVE_SCANNED)


SCANNED_OVERTIME = """CASE k % 4 WHEN 0 THEN 'Tôi là: ' || name || ' - Chức vụ: Kỹ sư' || chr(10) || 'thời gian làm việc 8h-17h. Do dự án ' || k || ', tôi đề nghị tăng ca.' || chr(10) || 'Thời gian đề nghị: Từ ngày ' || day || ' đến hết ngày ' || full_day || ', tăng thêm 2,5 giờ mỗi ngày, từ 18 giờ 30 phút đến 21 giờ với tổng thời gian dự kiến là ' || k % 50 || ' giờ.' || chr(10) || 'Nội dung công việc: kiểm thử ' || k || '. Tôi cam kết.'
 WHEN 1 THEN 'Tôi là: ' || name || ' - Chuc vu: Kỹ sư' || chr(10) || 'thi gian làm viêc 8h-17h. Do dự án ' || k || ', toi dê nghi tăng ca.' || chr(10) || 'Thi gian dê ngh: Tu ngày ' || day || ' dên hêt ngày ' || full_day || ', tăng thêm 2,5 gi mi ngày, tu 18 gi 30 phút dên 21 gi vi tông thi gian du kiên là ' || k % 50 || ' gi.' || chr(10) || 'Nôi dung công viêc kiểm thử ' || k || chr(10) || 'Tôi cam kêt'
 WHEN 2 THEN 'ngay 01/02/2020' || chr(10) || 'nghi: ' || day || ' - ' || full_day || ', tâng them 3 gio, tu 18 gio 15 phut den 20 gio 45 phut, tong thi gian khoang ' || k % 50 || ' gio' || chr(10) || 'NGƯỜI LÀM ĐƠN' || chr(10) || '(Ký tên)' || chr(10) || name
 ELSE 'Tôi là: ' || segment || ' - Chức vụ: Kỹ sư' || chr(10) || 'Thời gian đề nghị: Ngày ' || day || ', làm thêm 3 giờ, từ 18 giờ đến 21 giờ với tổng thời gian dự kiến là 3 giờ' || chr(10) || 'NGƯỜI LÀM ĐƠN' || chr(10) || name END"""
OVERTIME_SCANNED = ["employeeName", "jobTitle", "standardWorkSchedule", "reason", "startDate", "endDate", "overtimeHoursPerDay", "overtimeStartTime", "overtimeEndTime", "totalOvertimeHours", "workContent"]


@query(
    f"""WITH {CUSTOMERS}, d AS (SELECT *, strftime(strptime(full_day, '%d/%m/%Y'), '%Y-%m-%d') AS iso, k % 4 AS m FROM c)
SELECT k, name AS "employeeName", CASE WHEN m <> 2 THEN 'Kỹ sư' END AS "jobTitle", CASE WHEN m < 2 THEN '8h-17h' END AS "standardWorkSchedule", CASE WHEN m < 2 THEN 'dự án ' || k END AS reason, iso AS "startDate", iso AS "endDate", CASE WHEN m < 2 THEN '2.5' ELSE '3' END AS "overtimeHoursPerDay",
 CASE m WHEN 2 THEN '18:15' WHEN 3 THEN '18:00' ELSE '18:30' END AS "overtimeStartTime", CASE m WHEN 2 THEN '20:45' ELSE '21:00' END AS "overtimeEndTime", CASE m WHEN 3 THEN '3' ELSE (k % 50)::VARCHAR END AS "totalOvertimeHours", CASE WHEN m < 2 THEN 'kiểm thử ' || k END AS "workContent", '' AS conflicts FROM d"""
)
def scanned_overtime(spark, sf_dir):
    """Four readings of overtime requests: whole, marks lost, only figures and dates with a signature, a single day with a signature."""
    rows = customers(spark, sf_dir).withColumn("text", F.expr(SCANNED_OVERTIME.replace("chr(10)", "char(10)")))
    return picked(rows.withColumn("r", templates.overtime_request(F.col("text"), F.lit(True))), OVERTIME_SCANNED)


@query(
    f"""WITH {CUSTOMERS}, f AS (SELECT k, k % 8 AS m, kind, confidence, unnest(['employeeName', 'employeeId', 'department', 'leaveStartDate', 'leaveEndDate', 'leaveDays', 'leaveReason']) AS field,
 unnest(CASE k % 8 WHEN 0 THEN [name, staff, segment, day, full_day, '3 ngày', priority] WHEN 1 THEN [name, staff, segment, day, full_day, 'nghỉ 004', priority] WHEN 2 THEN [name, staff, segment, NULL, NULL, '0', priority] WHEN 3 THEN [NULL, staff, segment, NULL, NULL, NULL, priority]
   WHEN 4 THEN [name, staff, segment, day, full_day, '2', priority] WHEN 5 THEN [NULL, NULL, NULL, '31/02/2024', '45/01/2024', 'hai', NULL] WHEN 6 THEN [name, '1234567', NULL, '1/2/24', '3.2.24', '12,5', 'a | b'] ELSE [NULL, NULL, NULL, NULL, NULL, NULL, NULL] END) AS value,
 unnest(CASE k % 8 WHEN 0 THEN [name, staff, segment, full_day, full_day, '3', priority] WHEN 1 THEN [name, staff, segment, full_day, full_day, '4', priority] WHEN 2 THEN [name, staff, segment, NULL, NULL, '0', priority] WHEN 3 THEN [NULL, staff, segment, NULL, NULL, NULL, priority]
   WHEN 4 THEN [name, staff, segment, full_day, full_day, '2', priority] WHEN 6 THEN [name, '1234567', NULL, '01/02/2024', '03/02/2024', '12', 'a | b'] ELSE [NULL, NULL, NULL, NULL, NULL, NULL, NULL] END) AS normalized,
 unnest([true, staff_ok AND k % 8 <> 6, true, k % 8 <> 5, k % 8 <> 5, k % 8 NOT IN (2, 5), true]) AS valid FROM c)
SELECT k, 'LEAVE_REQUEST' AS document_type, field, value, normalized, {GRADED} FROM f"""
)
def varied_forms(spark, sf_dir):
    """One leave request in eight layouts: colons, dashes and capitals, values in the next block, labels one after another, competing values, days that are none, short years, nothing at all."""
    span = lambda a, b: text("Từ ", a, " đến ", b)
    by = [
        blocks(text("Họ và tên: ", "name"), text("Mã NV: ", "staff"), text("Bộ phận: ", "segment"), text("Thời gian nghỉ: Từ ", "day", " đến ", "full_day"), text("Số ngày nghỉ: 3 ngày"), text("Lý do: ", "priority")),
        blocks(text("HỌ TÊN - ", "name"), text("MÃ NHÂN VIÊN   ", "staff"), text("phòng ban-", "segment"), text("xin nghỉ từ  ", "day", "  ĐẾN ", "full_day"), text("Số ngày nghỉ: nghỉ 004"), text("LÝ DO", ":- ", "priority", " |")),
        blocks(text("Họ và tên"), text("name"), text("Mã NV :"), text("staff"), text("Bộ phận -"), text("segment"), text("Số ngày nghỉ"), text("0"), text("Lý do"), text("priority")),
        blocks(text("Họ và tên"), text("Mã NV: ", "staff"), text("Bộ phận"), text("segment"), text("Số ngày nghỉ"), text("Lý do: ", "priority"), text("ĐƠN XIN NGHỈ PHÉP")),
        blocks(text("Mã NV: ", "staff"), text("Mã NV: khác"), text("Họ tên: ", "name"), text("Họ và tên: khác"), text("Bộ phận"), text("segment"), text("Bộ phận: khác"), text("Từ ", "day", " đến ", "full_day"), text("Từ 1/1/1999 đến 2/1/1999"), text("Số ngày nghỉ: 2"), text("Lý do: ", "priority")),
        blocks(span("31/02/2024", "45/01/2024"), text("Số ngày nghỉ: hai"), text("xx Họ và tên: giữa dòng"), text("Lý do"), text("Ghi chú: không")),
        blocks(text("  "), text("Họ tên: ", "name"), text("Mã NV: 1234567"), span("1/2/24", "3.2.24"), text("Số ngày nghỉ: 12,5"), text("Lý do: a | b")),
        blocks(text("ĐƠN XIN NGHỈ PHÉP"), text("Kính gửi"), text("")),
    ]
    out = by[7]
    for i in range(7):
        out = F.when(F.col("k") % 8 == i, by[i]).otherwise(out)
    rows = customers(spark, sf_dir).select("k", F.lit("LEAVE_REQUEST").alias("document_type"), out.alias("blocks"))
    return listed(forms.read_forms(rows))
