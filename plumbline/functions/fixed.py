"""Fixed values that results depend on, stated as plain data.

Everything here is a default: each operator that uses one of these lists takes
it as a parameter.
"""

from __future__ import annotations

# Labels for missing text.
NONE_LABEL = "无"
EMPTY_LABEL = "<<EMPTY>>"

# File extensions by family.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "gif", "tif", "tiff", "heic", "avif"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "flv", "wmv", "mpeg", "mpg", "m4v", "webm", "ts", "3gp"]
VIDEO_SUFFIX_CHECK = ["mp4", "mov", "avi", "mkv", "webm"]

# Platform names and the patterns that point to them, first match wins.
PLATFORM_PATTERNS = [
    ("天猫", r"天猫(?:主图|店铺|旗舰店|商城)?"),
    ("淘宝", r"淘宝(?:主图|店铺)?"),
    ("唯品会", r"唯品会(?:主图)?"),
    ("唯品会", r"唯品"),
    ("快手", r"快手(?:版|店铺|小店)?"),
    ("拼多多", r"拼多多(?:店铺|温馨提示)?"),
    ("拼多多", r"\bPDD\b"),
    ("抖音", r"抖音(?:店铺|小店)?"),
    ("抖音", r"Douyin"),
    ("京东", r"京东(?:主图|店铺)?"),
    ("京东", r"JD"),
    ("小红书", r"小红书"),
    ("视频号", r"视频号"),
    ("得物", r"得物"),
    ("唯品仓", r"唯品仓"),
]

# Patterns used when asking why a platform is missing.
DIAGNOSIS_PATTERNS = [
    ("天猫", r"天猫"),
    ("淘宝", r"淘宝"),
    ("唯品会", r"唯品会"),
    ("唯品会", r"唯品"),
    ("快手", r"快手"),
    ("拼多多", r"拼多多"),
    ("拼多多", r"\bPDD\b"),
    ("抖音", r"抖音"),
    ("京东", r"京东"),
    ("京东", r"\bJD\b"),
    ("小红书", r"小红书"),
    ("视频号", r"视频号"),
    ("得物", r"得物"),
]

# Texts that name image content, never a platform.
CONTENT_LABELS = [
    "商品内页", "详情图", "详情页", "主图", "白底图", "灰底图", "素材图", "配色图", "尺码图", "面料图",
    "内页图", "温馨提示", "选购图", "海报图", "场景图", "平铺图", "挂拍图", "细节图", "穿搭图", "小图",
]
DIAGNOSIS_CONTENT_TERMS = [
    "商品内页", "详情图", "详情页", "主图", "白底图", "灰底图", "素材图", "配色图", "尺码图", "面料图",
    "内页图", "温馨提示", "选购图", "海报图", "场景图", "平铺图", "挂拍图", "细节图", "穿搭图", "官网主图",
]

# Platforms looked for in paths of rows without an explicit platform.
RECOVERABLE_PLATFORMS = ["唯品会", "天猫", "淘宝", "快手", "拼多多", "抖音", "京东", "小红书", "视频号", "得物"]

# Product families, first match wins.
FAMILY_PATTERNS = [
    ("鞋靴", "鞋|靴|凉鞋|拖鞋|单鞋|玛丽珍"),
    ("裤装", "裤"),
    ("裙装/内衣/泳装", "裙|内衣|泳|连体衣|连身衣|背心|吊带"),
    ("套装", "套装"),
    ("上装", "外套|衫|衣|服|上衣|马甲|羽绒|防晒|针织衫|大衣"),
    ("球拍球线/器材", "球|拍|线|柄皮|器材|器械|耗材"),
    ("配件/护具/包袜", "帽|包|袜|配件|护具|手套|围巾|壶|镜|公仔|玩偶"),
]
FAMILY_DEFAULT = "其他"

# Family defaults of the action plan (family, bucket, proposed value, confidence).
MERGE = "归并候选"
ADD = "新增候选"
FAMILY_ACTIONS = [
    ("鞋靴", MERGE, "运动生活鞋类", "low"),
    ("裤装", MERGE, "运动裤类", "low"),
    ("上装", MERGE, "外套", "low"),
    ("套装", MERGE, "套装类", "medium"),
]

# Rule coverage states.
RULE_TARGET = "历史规则目标已定义"
RULE_ALIAS = "历史规则别名已定义"
RULE_UNCOVERED = "历史规则未覆盖"

# Gender texts that the gender mapping knows.
MAPPED_GENDERS = ["中", "中性", "女", "女性", "男", "男性", "女童", "男童", "婴幼儿", "童"]

# Customer segments.
SEGMENT_VALUE = "重要价值客户"
SEGMENT_KEEP = "重要保持客户"
SEGMENT_WIN_BACK = "重要挽回客户"
SEGMENT_ACTIVE = "一般活跃客户"
SEGMENT_RISK = "流失风险客户"

# Industry ranges in percent (metric, industry, low, high).
BENCHMARKS = [
    ("dau_mau", "B2B SaaS", 15.0, 25.0), ("dau_mau", "B2C App", 20.0, 35.0),
    ("dau_mau", "电商", 10.0, 20.0), ("dau_mau", "社交", 40.0, 60.0),
    ("retention_d1", "B2B SaaS", 35.0, 45.0), ("retention_d1", "B2C App", 25.0, 35.0),
    ("retention_d1", "电商", 20.0, 30.0), ("retention_d1", "社交", 40.0, 55.0),
    ("retention_d7", "B2B SaaS", 25.0, 40.0), ("retention_d7", "B2C App", 15.0, 25.0),
    ("retention_d7", "电商", 10.0, 20.0), ("retention_d7", "社交", 30.0, 45.0),
    ("retention_d30", "B2B SaaS", 15.0, 25.0), ("retention_d30", "B2C App", 8.0, 15.0),
    ("retention_d30", "电商", 5.0, 12.0), ("retention_d30", "社交", 20.0, 35.0),
    ("monthly_churn", "B2B SaaS", 3.0, 5.0), ("monthly_churn", "B2C App", 5.0, 10.0),
    ("monthly_churn", "电商", 8.0, 15.0), ("monthly_churn", "社交", 2.0, 4.0),
]

# Churn threshold in days by scenario.
SCENARIO_CHURN_DAYS = {"B2B SaaS": 7, "B2C App": 14, "电商平台": 30, "社交平台": 3}

# Targets of the churn classifier.
CHURN_TARGETS = {"accuracy": 0.85, "recall": 0.80, "precision": 0.70, "f1": 0.75}

# Table layers by name prefix.
LAYER_PREFIXES = [
    ("ods_", "ODS 原始层"), ("dwd_", "DWD 明细层"), ("dws_", "DWS 汇总层"), ("dim_", "DIM 维度层"),
    ("dm_", "DM 应用层"), ("ads_", "ADS 应用层"), ("tmp_", "TMP 临时层"),
]
LAYER_UNKNOWN = "未识别层级"

# Comments for well-known column names.
COLUMN_COMMENTS = {
    "file_id": "文件唯一标识。", "platform_source_id": "平台侧素材实例 ID。", "platform": "平台标识。",
    "brand": "品牌标识。", "spu": "商品 SPU。", "sku": "商品 SKU。", "sku_id": "商品 SKU ID。",
    "product_id": "商品 ID。", "product_name": "商品名称。", "title": "标题。", "author": "作者或达人。",
    "good_ids": "挂车商品 ID 集合。", "full_path": "完整路径。", "concatenated_path": "标准化拼接路径。",
    "file_name": "文件名。", "file_type": "文件类型。", "picture_type": "图片类型。",
    "picture_wear": "图片穿搭属性。", "picture_size": "图片文件大小。", "video_duration_type": "视频时长分类。",
    "video_wide_range": "视频画幅分类。", "scene": "场景标签。", "style": "风格标签。", "gender": "性别标签。",
    "big_cate": "品牌大类。", "mid_cate": "中类规整。", "sub_track": "细分赛道。", "publish_date": "发布日期。",
    "create_time": "创建时间。", "update_time": "更新时间。", "width": "宽度像素。", "height": "高度像素。",
    "resolution": "分辨率。", "room_id": "直播间或场次 ID。", "child_order_no": "子订单号。",
    "order_amount": "订单金额。", "pay_amount": "支付金额。", "item_num": "商品件数。",
    "shop_name": "店铺名称。", "erp_shop_id": "ERP 店铺 ID。",
}
# What a column name ending or part says about the column.
COLUMN_SUFFIX_COMMENTS = [
    (["_id"], "标识字段。"), (["_time"], "时间字段。"), (["_date"], "日期字段。"),
    (["_cnt", "_count"], "计数字段。"), (["_amount", "_amt"], "金额字段。"), (["_rate"], "比率字段。"),
]
COLUMN_PART_COMMENTS = [("path", "路径字段。"), ("name", "名称字段。")]
COLUMN_COMMENT_DEFAULT = "字段，暂无显式注释，按字段名推断。"

# The six root-cause buckets.
ROOT_CAUSES = [
    "source_pollution",
    "mapping_mistake",
    "bridge_key_missing",
    "wrong_grain",
    "rule_coverage_gap",
    "display_formatting",
]

# Confidence caps by record count (lower bound exclusive as noted in confidence_cap).
CONFIDENCE_CAPS = {"small": 0.70, "medium": 0.85, "large": 0.95}

# Actions and what triggers them.
ACTION_TEMPLATES = [
    ("churn_win_back", "critical", "针对流失风险用户推送个性化挽回内容", "挽回率 ≥ 38%", "立即执行，3天内完成触达", "用户运营团队"),
    ("retention_onboarding", "high", "优化新用户引导流程，突出高留存功能", "7日留存提升至50%", "2周设计 + 1周开发 + 1周测试", "产品团队 + 设计团队"),
    ("cold_feature_review", "medium", "评估冷门功能，优化或下线", "节省20%开发资源", "1个月评估 + 2个月执行", "产品团队 + 研发团队"),
]
