"""Column layouts of the domain tables, as DDL."""

TRACE_EVENT = "device_id long, seq long, act string, flag int, addr long, size long, stack array<long>, module string"
SYMBOL = "addr long, path string, line int"
PACKET = (
    "ssrc long, arrival long, ts timestamp, seq int, rtp_ts long, pt int, marker boolean, version int, has_ext boolean, "
    "cc int, length int, direction string, key_id string, auth_ok boolean, payload binary"
)
POLICY = "ssrc_type string, ssrc long, window int, allow_repeat boolean, key_limit long"
SAMPLE = "stream_id string, ch int, n long, x double"
FRAME = "stream_id string, frame_idx long, sample_rate int, channel int, bits int, samples array<double>"
MEDIA_FRAME = "file_id string, stream_type string, stream_id int, frame_idx long, pts long, dts long, key_frame boolean, size long, pos long, flag int"
MIDI_EVENT = "file_id string, track int, seq long, delta_ticks long, type int, channel int, note int, velocity int, program int, tempo_us long"
ZONE = "zone_ord int, idx int, note int, vel_min int, vel_max int, name string, offset long, size long"
PIXEL = "frame_id long, x int, y int, r int, g int, b int"
IMAGE_FRAME = "frame_id long, width int, height int, fmt string, data binary"
SESSION_EVENT = "device_id string, ts timestamp, event string"
TAG = (
    "path string, version string, title string, author string, album string, date string, genre string, cover_mime string, "
    "cover_size long, encoding int, extra array<struct<key:string,value:string,encoding:int>>"
)
