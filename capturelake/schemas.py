"""Fixed schemas of working tables and files as DDL text; nothing is inferred."""

from __future__ import annotations

POSE = "struct<tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>"
INTRINSICS = "struct<fx:double,fy:double,cx:double,cy:double,width:int,height:int>"
RECT = "struct<left:int,top:int,right:int,bottom:int>"
FILE_INTRINSICS = "struct<focal_length_px:array<double>,principal_point_px:array<double>,image_dimensions:array<int>>"

POSES = (
    f"session_id string, seq long, timestamp_ns long, tracking_state string, pose {POSE}, "
    f"image_k {INTRINSICS}, texture_k {INTRINSICS}, lens_state int, af_state int")
CAMERA_STATES = (
    "session_id string, seq long, timestamp_ns long, exposure_time_ns long, iso int, "
    "focus_distance float, af_state int, lens_state int")
STILL_METADATA = (
    "session_id string, seq long, timestamp_ns long, exposure_time_ns long, iso int, aperture float, "
    "focal_length_mm float, focus_distance_diopters float, af_mode int, af_state int, ae_state int, awb_state int, "
    "lens_state int, ois_mode int, video_stabilization_mode int, rolling_shutter_skew_ns long, "
    f"frame_duration_ns long, crop_region {RECT}, jpeg_orientation_degrees int")
IMAGES = ("session_id string, seq long, timestamp_ns long, path string, jpeg_width int, jpeg_height int")
CONTROL_EVENTS = ("session_id string, seq long, kind string")
DEPTH_REFS = ("session_id string, seq long, timestamp_ns long, frame_id long")
DEPTH_FRAMES = (
    "session_id string, seq long, frame_id long, timestamp_ns long, width int, height int, depth16 binary, "
    "confidence binary, conf_row_stride int, conf_pixel_stride int, y_plane binary, u_plane binary, v_plane binary, "
    "y_row_stride int, y_pixel_stride int, u_row_stride int, u_pixel_stride int, v_row_stride int, "
    f"v_pixel_stride int, color_width int, color_min_y float, color_max_y float, texture_k {INTRINSICS}, pose {POSE}")
POINTS = (
    "session_id string, frame_id long, i long, x float, y float, z float, red smallint, green smallint, "
    "blue smallint, confidence float")

CAMERA2 = (
    "struct<exposure_time_ns:long,iso:int,aperture_f_number:double,focal_length_mm:double,"
    "focus_distance_diopters:double,af_mode:int,af_state:int,ae_state:int,awb_state:int,lens_state:int,ois_mode:int,"
    "video_stabilization_mode:int,rolling_shutter_skew_ns:long,frame_duration_ns:long,jpeg_orientation_degrees:int,"
    f"crop_region:{RECT},camera_id:string>")
PHOTO_METADATA = (
    "struct<sensor_timestamp_ns:long,exposure_time_ns:long,frame_duration_ns:long,rolling_shutter_skew_ns:long,iso:int,"
    "aperture_f_number:double,focal_length_mm:double,focus_distance_diopters:double,focus_range_diopters:array<double>,"
    "lens_state:int,af_mode:int,af_state:int,ae_state:int,awb_state:int,ois_mode:int,video_stabilization_mode:int,"
    "lens_intrinsic_calibration:array<double>,lens_radial_distortion:array<double>>")
QUALITY_GATE = (
    "struct<target_shutter:string,max_saved_exposure_ns:long,max_saved_iso:int,max_linear_speed_mps:double,"
    "max_angular_speed_dps:double,max_pose_match_delta_ns:long,max_depth_match_delta_ns:long,profile:string,"
    "linear_speed_mps:double,angular_speed_dps:double,max_exposure_ns:long,jpeg_quality:int>")

# One superset for the keyframe documents of all three profiles.
KEYFRAME = (
    "capture_index int, image string, point_cloud string, jpeg_width int, jpeg_height int, "
    "jpeg_sensor_timestamp_ns long, arcore_pose_timestamp_ns long, pose_timestamp_delta_ns long, "
    "raw_depth_timestamp_ns long, depth_timestamp_delta_ns long, point_count int, "
    "point_cloud_coordinate_system string, width int, height int, frame_timestamp_ns long, image_timestamp_ns long, "
    "translation_m array<double>, rotation_quaternion_xyzw array<double>, "
    "world_from_camera_column_major array<double>, camera_from_world_column_major array<double>, "
    "forward_world array<double>, up_world array<double>, "
    f"arcore_image_intrinsics {FILE_INTRINSICS}, arcore_texture_intrinsics {FILE_INTRINSICS}, "
    f"intrinsics {FILE_INTRINSICS}, camera2_capture {CAMERA2}, camera_metadata {PHOTO_METADATA}, "
    f"capture_quality_gate {QUALITY_GATE}")

TRANSFORM_FRAME = (
    "struct<file_path:string,depth_point_cloud_path:string,w:int,h:int,fl_x:double,fl_y:double,cx:double,cy:double,"
    "capture_index:int,timestamp_ns:long,transform_matrix:array<array<double>>>")
TRANSFORMS = (
    "camera_model string, k1 double, k2 double, p1 double, p2 double, coordinate_system string, source string, "
    f"frames array<{TRANSFORM_FRAME}>")
TRAJECTORY = (
    "index int, image string, point_cloud string, image_timestamp_ns long, pose_timestamp_ns long, "
    "tx double, ty double, tz double, qx double, qy double, qz double, qw double")
SESSION_CAMERA = (
    "manufacturer string, brand string, model string, device string, sdk_int int, profile string, "
    "capture_profile string, camera_id string, jpeg_width int, jpeg_height int, jpeg_megapixels double, "
    f"sensor_orientation_degrees int, active_array {RECT}, available_apertures array<double>, "
    "available_focal_lengths_mm array<double>, available_af_modes array<int>, available_ois_modes array<int>, "
    "lens_intrinsic_calibration array<double>, lens_distortion array<double>, dataset_contents string, "
    "capture_policy string, focus_policy string, stabilization_policy string, aperture_policy string, "
    "eis_policy string, max_exposure_ns long, max_linear_speed_mps double, max_angular_speed_dps double")
