"""The tables that stages exchange."""

FRAMES = "video_id string, frame_index long, time_s double, width int, height int, data binary"
KEYFRAMES = "id long, frame_index long, time_s double, segment int, sharpness double"
EDGES = "i long, j long, dx double, dy double, phi double, quality double, ncc double, overlap double, kind string"
POSES = "id long, x double, y double, theta double"
LINKS = "attempt int, segment_size int, source string, status string, main_kf long, seg_kf long, main_frame long, seg_frame long, ncc double, second_peak double, quality double, overlap double, tx double, ty double, rot_deg double, residual_px double"
